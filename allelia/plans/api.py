"""Entry points: null model, single-variant and set association, relationship matrix, LD, effects.

Inputs are relations or a `GenotypeSource`; settings are immutable. Vectors of the length of the sample are
on the driver and broadcast, markers stay distributed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelia.operators import aggregates, effects, joins, nullmodel, qc, regions, relationship, score
from allelia.plans import storage
from allelia.sources import bcf, blocks, genotypes, text


def between(name: str, value: float, low: float, high: float, open_low: bool = False) -> float:
    """Numeric bounds of an argument."""
    if not (math.isfinite(value) and (value > low if open_low else value >= low) and value <= high):
        raise ValueError(f"{name} must be {'above' if open_low else 'at least'} {low} and at most {high}")
    return value


@dataclass(frozen=True)
class GenotypeSource:
    """Where genotypes are. Of several kinds the first of bgen, vcf, bed and pgen is read."""

    bed: str | None = None
    bim: str | None = None
    fam: str | None = None
    bgen: str | None = None
    vcf: str | None = None
    pgen: str | None = None
    pvar: str | None = None
    psam: str | None = None
    field: str = "DS"
    samples: str | None = None
    alleles: str = "alt-first"

    def __post_init__(self):
        if self.kind is None:
            raise ValueError("give one of bgen, vcf, bed and pgen")
        if self.kind == "bed" and not (self.bim and self.fam):
            raise ValueError("a bed file needs its bim and fam files")
        if self.kind == "pgen" and not (self.pvar and self.psam):
            raise ValueError("a pgen file needs its pvar and psam files")
        if self.kind == "vcf" and self.field not in ("DS", "GT"):
            raise ValueError("the field is DS or GT")
        if self.alleles not in blocks.ALLELES:
            raise ValueError("alleles are alt-first or ref-first")

    @property
    def kind(self) -> str | None:
        return next((k for k in ("bgen", "vcf", "bed", "pgen") if getattr(self, k)), None)

    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(samples: iid, sample_idx), (markers: marker_id, chrom, pos, ref, alt, ...), (calls: sample_id = sample_idx, marker_id, dosage)

        bed and pgen files are read by byte ranges, many tasks a file; bgen records by the ranges of their index.
        """
        return getattr(self, f"_{self.kind}")(spark)

    def _bed(self, spark):
        fam = _lines(spark, self.fam).select(F.split(F.trim("line"), r"\s+")[1].alias("iid"), "place").withColumnRenamed("place", "sample_idx")
        c = F.split(F.trim("line"), r"\s+")
        first, second = (c[4], c[5]) if self.alleles == "alt-first" else (c[5], c[4])
        markers = _lines(spark, self.bim).select(F.col("place").cast("long").alias("marker_id"), c[0].alias("chrom"), c[1].alias("id"), c[3].cast("int").alias("pos"), F.upper(second).alias("ref"), F.upper(first).alias("alt"))
        return fam, markers, _calls(blocks.read_bed(spark, self.bed, fam.count(), alleles=self.alleles))

    def _pgen(self, spark):
        psam = _lines(spark, self.psam).where("not startswith(line, '#')")
        samples = psam.select(F.split("line", r"[\t ]")[0].alias("iid"), (F.col("place") - F.col("skipped")).alias("sample_idx"))
        pvar = _lines(spark, self.pvar)
        head = [x.strip() for x in pvar.where("startswith(line, '#CHROM')").first().line.split("\t")]
        at = {name: head.index(name) for name in ("POS", "ID", "REF", "ALT")}
        c = F.split("line", "\t")
        markers = pvar.where("not startswith(line, '#')").select((F.col("place") - F.col("skipped")).cast("long").alias("marker_id"), c[0].alias("chrom"), c[at["ID"]].alias("id"), c[at["POS"]].cast("int").alias("pos"), F.upper(c[at["REF"]]).alias("ref"), F.upper(c[at["ALT"]]).alias("alt"))
        return samples, markers, _calls(blocks.read_pgen(spark, self.pgen))

    def _bgen(self, spark):
        x = storage.saved(blocks.read_bgen_markers(blocks.bgen_index(spark, self.bgen), self.bgen), "bgen")
        markers = x.select(F.col("marker_index").alias("marker_id"), "chrom", F.col("rsid").alias("id"), "pos", F.col("a1").alias("ref"), F.col("a2").alias("alt"), "info")
        if self.samples:
            ids = [r.iid for r in text.read_sample_ids(spark, self.samples).select("iid").collect()]
        else:  # the head alone: one id a sample
            store, _ = blocks.store_of(self.bgen)
            read = blocks.ranged(store, blocks.files_of(self.bgen, ".bgen")[0][0])
            ids = genotypes.bgen_header(read(0, int.from_bytes(read(0, 4), "little") + 4))["ids"]
        samples = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "iid string, sample_idx int")
        return samples, markers, _calls(x)

    def _vcf(self, spark):
        """Text, block-gzipped text (.gz, .bgz) or BCF; the last two are read by ranges, many tasks a file."""
        if self.vcf.endswith(".bcf"):
            store, _ = blocks.store_of(self.vcf)
            file, size = blocks.files_of(self.vcf, ".bcf")[0]
            head = bcf.header_end(blocks.ranged(store, file), size)[0].samples
            markers, dosages = bcf.markers_and_dosages(storage.saved(bcf.read_bcf(spark, self.vcf, self.field), "bcf"))
        else:
            lines = bcf.read_lines(spark, self.vcf) if self.vcf.endswith(("gz", "bgz")) else spark.read.text(self.vcf)
            markers, dosages = text.read_vcf(spark, self.vcf, self.field, lines)
            head = lines.where(F.col("value").startswith("#CHROM")).first().value.split("\t")[9:]
        samples = spark.createDataFrame(list(zip(head, range(len(head)))), "iid string, sample_idx int")
        return samples, markers, dosages.select(F.col("column").cast("long").alias("sample_id"), "marker_id", "dosage")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place, skipped): the lines of a text file, their places, and how many head lines (with #) come before."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("place", "line"))
    return x.crossJoin(F.broadcast(x.agg(F.count_if(F.col("line").startswith("#")).cast("int").alias("skipped"))))  # one row


def _calls(sparse: DataFrame) -> DataFrame:
    return genotypes.long_form(sparse).select(F.col("sample_idx").cast("long").alias("sample_id"), F.col("marker_index").alias("marker_id"), "dosage")


@dataclass(frozen=True)
class NullSettings:
    trait: str = "quantitative"
    covariates: tuple[str, ...] = ()
    outcome: str = "y"
    time: str | None = None
    inverse_normal: bool = False
    covariate_offset: bool = False
    min_maf: float = 0.01
    max_missing: float = 0.15
    loco: bool = False
    n_ratio_markers: int = 30
    ratio_min_mac: float = 20.0
    ratio_edges: tuple[float, ...] = ()
    solver: nullmodel.Settings = field(default_factory=nullmodel.Settings)

    def __post_init__(self):
        if self.trait not in ("quantitative", "binary", "survival"):
            raise ValueError("the trait is quantitative, binary or survival")
        if self.trait == "survival" and not self.time:
            raise ValueError("survival needs a time column")
        between("min_maf", self.min_maf, 0, 0.5)
        between("max_missing", self.max_missing, 0, 1)


@dataclass
class NullFit:
    model: nullmodel.NullModel
    sample_index: DataFrame
    ratios: list[float]
    ratio_edges: list[float]
    loco: dict[int, nullmodel.NullModel]
    covariates: list[int]


def fit_null(phenotypes: DataFrame, calls: DataFrame, markers: DataFrame, settings: NullSettings = NullSettings(), relationship_matrix: DataFrame | None = None) -> NullFit:
    """Step 1: phenotypes (sample_id, outcome, covariates), calls, markers -> fitted model, variance ratios
    and, if asked for, refits without each chromosome."""
    s, spark = settings, phenotypes.sparkSession
    needed = [s.outcome, *s.covariates, *([s.time] if s.time else [])]
    p = phenotypes.select("sample_id", *needed).dropna()
    genotyped = calls.select("sample_id").distinct()
    p = p.join(genotyped, "sample_id", "left_semi")
    if s.trait == "survival":
        p = qc.pre_censor(p.withColumn("event", F.col(s.outcome)).withColumn("time", F.col(s.time)))
    if s.inverse_normal and s.trait == "quantitative":
        p = aggregates.inverse_normal(p, s.outcome).withColumn(s.outcome, F.col("z")).drop("z")
    rows = p.toPandas().sort_values("sample_id").reset_index(drop=True)  # one row a sample
    n = len(rows)
    x = np.column_stack([*([np.ones(n)] if s.trait != "survival" else []), *[rows[c].to_numpy(float) for c in s.covariates]]) if s.covariates or s.trait != "survival" else np.ones((n, 1))
    q, r, kept = nullmodel.orthogonal_covariates(x)
    y = rows[s.outcome].to_numpy(float)
    offset = np.zeros(n)
    if s.covariate_offset and s.trait != "survival":
        _, offset = nullmodel.glm(x[:, kept], y, s.trait)
        q, r, kept = np.ones((n, 1)), np.ones((1, 1)), [0]
    idx = spark.createDataFrame([(int(i), k) for k, i in enumerate(rows.sample_id)], "sample_id long, sample_idx int")
    g = calls.join(idx.select("sample_id"), "sample_id", "left_semi")
    counts = storage.saved(qc.after_imputation(qc.allele_counts(g, spark.createDataFrame([(n,)], "n long"))), "counts")
    good = qc.relationship_markers(counts, s.min_maf, s.max_missing).select("marker_id")
    filled = storage.saved(qc.impute_and_flip(g, counts).select("sample_id", "marker_id", F.when(F.col("flip"), 2 - F.col("g")).otherwise(F.col("g")).alias("dosage")).where("dosage > 0"), "filled")
    w = storage.saved(relationship.marker_weights(filled.join(good, "marker_id", "left_semi"), n), "weights")
    if relationship_matrix is not None:
        cells = joins.sample_pairs(relationship_matrix, idx).toPandas()  # related pairs only
        operator = relationship.SparseOperator(cells.row.to_numpy(), cells.col.to_numpy(), cells.value.to_numpy(), n)
        diagonal = operator.diagonal()
        loco = {}
    else:
        operator = relationship.kinship_operator(filled, idx, n, w)
        diagonal = _diagonal(filled, w, idx, n)
    ids = rows.sample_id.tolist()
    time = rows[s.time].to_numpy(float) if s.time else None
    model = nullmodel.fit(operator, diagonal, q, y, ids, s.trait, s.solver, offset, time)
    fits = {}
    if s.loco and relationship_matrix is None:
        chroms = sorted({r.chrom for r in markers.join(w, "marker_id").select("chrom").distinct().collect()}, key=str)
        if len(chroms) > 1:  # one operator whose columns each leave a chromosome out
            numbers = spark.createDataFrame([(c, k) for k, c in enumerate(chroms)], markers.select("chrom", F.lit(0).alias("code")).schema)
            code = markers.join(F.broadcast(numbers), "chrom").select("marker_id", F.col("code").alias("chrom"))
            parts = relationship.kinship_operator(filled, idx, n, w.join(code, "marker_id"))
            found = nullmodel.leave_one_chromosome(parts, parts.diagonals(), model, s.solver, time)
            fits = {chroms[k]: one for k, one in found.items()}
    ratios = []
    edges = list(s.ratio_edges) or [s.ratio_min_mac]
    tops = [*edges[1:], math.inf]
    for low, high in zip(edges, tops):
        pool = counts.where((F.col("mac") >= low) & (F.col("mac") < high)).orderBy(qc.hash_order("marker_id", 1)).limit(s.n_ratio_markers).select("marker_id")
        few = score.packed_markers(filled.join(F.broadcast(pool), "marker_id", "left_semi"), idx).collect()
        if not few:
            raise ValueError(f"no markers to estimate the variance ratio from {low} to {high}")
        block = np.zeros((n, len(few)))
        for k, row in enumerate(few):
            block[row.idx, k] = row.dos
        block = np.where(block.sum(axis=0) > n, 2 - block, block)
        ratios.append(float(np.mean(nullmodel.variance_ratio(operator, diagonal, model, block, s.solver))))
    model.alpha = nullmodel.back_transformed(model.alpha, r)
    return NullFit(model, idx, ratios, edges, fits, kept)


def _diagonal(g: DataFrame, w: DataFrame, idx: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for r in relationship.diagonal_kinship(g, w, idx).join(idx, "sample_id").select("sample_idx", "value").toPandas().itertuples():
        out[r.sample_idx] = r.value
    return out


def assoc_single(fit: NullFit, calls: DataFrame, markers: DataFrame, tests: score.TestSettings | None = None, min_maf: float = 0.0, min_mac: float = 0.5, max_missing: float = 0.15, fill: str = "best_guess", condition: list | None = None, relationship_matrix: DataFrame | None = None, two_stage_cutoff: float = 0.05) -> DataFrame:
    """Step 2: quality control, imputation, tests of all markers; by left-out chromosome if the fit has them.

    With a sparse relationship matrix markers with p below the cutoff are tested again with it (column `stage`).
    """
    spark, n = calls.sparkSession, len(fit.model.y)
    tests = tests or score.TestSettings(fit.model.trait)
    g = calls.join(fit.sample_index.select("sample_id"), "sample_id", "left_semi")
    counts = qc.after_imputation(qc.allele_counts(g, spark.createDataFrame([(n,)], "n long")), fill)
    keep = qc.second_filter(qc.marker_filter(counts, max_missing, min_maf, min_mac), min_maf, min_mac)
    filled = qc.impute_and_flip(g.join(keep.select("marker_id"), "marker_id", "left_semi"), counts, fill)
    long = filled.select("sample_id", "marker_id", F.when(F.col("flip"), 2 - F.col("g")).otherwise(F.col("g")).alias("dosage")).where("dosage > 0")
    long = long.join(markers.select("marker_id", "chrom"), "marker_id")
    block = _conditioning(fit, long, condition) if condition else None
    parts = []
    ratios = score.Ratios(tuple(fit.ratios), tuple(fit.ratio_edges))
    for chrom, model in {None: fit.model, **(fit.loco or {})}.items():  # None: chromosomes without a fit of their own
        other = ~F.col("chrom").isin(list(fit.loco)) | F.col("chrom").isNull() if fit.loco else F.lit(True)
        own = long.where(other if chrom is None else F.col("chrom") == chrom)
        if block is None and relationship_matrix is not None:
            related = joins.sample_pairs(relationship_matrix, fit.sample_index).toPandas()  # related pairs only
            cells = related.row.to_numpy(), related.col.to_numpy(), related.value.to_numpy()
            parts.append(score.tested_in_two_stages(own, fit.sample_index, model, cells, tests, ratios, ratios, two_stage_cutoff))
        elif block is None:
            parts.append(score.tested(own, fit.sample_index, model, tests, ratios))
        else:
            packed = score.packed_markers(own, fit.sample_index)
            mac = F.aggregate("dos", F.lit(0.0), lambda a, x: a + x)
            ratio = ratios.column(F.least(mac, 2.0 * n - mac))
            parts.append(score.associate(packed.withColumn("ratio", ratio), model, tests, fit.ratios[-1], block))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def assoc_region(fit: NullFit, calls: DataFrame, groups: DataFrame, masks: list[str], cutoffs: list[float], rare_mac: float = 10.0, condition: list | None = None, burden_only: bool = False) -> DataFrame:
    """Set tests: groups (region, marker_id, anno, optionally weight) -> rows per mask and cutoff, and one Cauchy row a
    region. With markers to condition on there are results given them, too."""
    n = len(fit.model.y)
    g = calls.join(fit.sample_index.select("sample_id"), "sample_id", "left_semi")
    counts = qc.after_imputation(qc.allele_counts(g, calls.sparkSession.createDataFrame([(n,)], "n long")))
    filled = qc.minor_dosages(g, counts, fit.sample_index)
    members = aggregates.mask_members(joins.in_masks(groups, masks), qc.region_filter(counts, 0.15, 0, 0, 0.5), cutoffs)
    if "weight" in groups.columns:
        members = members.join(groups.select("region", "marker_id", "weight"), ["region", "marker_id"])
    block = _conditioning(fit, filled, condition) if condition else None
    settings = regions.SetSettings(rare_mac=rare_mac, burden_only=burden_only, ratios=score.Ratios(tuple(fit.ratios), tuple(fit.ratio_edges)))
    return regions.with_cauchy(regions.test_regions(members, filled, fit.sample_index, fit.model, settings=settings, condition=block))


def assoc_single_in_group(fit: NullFit, calls: DataFrame, markers: DataFrame, groups: DataFrame, masks: list[str], cutoffs: list[float], rare_mac: float = 10.0) -> DataFrame:
    """Single tests of the markers of sets: name, region, mask and max_maf (null for a marker) and the columns of
    score.RESULT; rare markers by themselves, the ultra-rare ones of each set as one collapsed marker."""
    n = len(fit.model.y)
    g = calls.join(fit.sample_index.select("sample_id"), "sample_id", "left_semi")
    counts = qc.after_imputation(qc.allele_counts(g, calls.sparkSession.createDataFrame([(n,)], "n long")))
    filled = qc.minor_dosages(g, counts, fit.sample_index)
    members = aggregates.mask_members(joins.in_masks(groups, masks), qc.region_filter(counts, 0.15, 0, 0, 0.5), cutoffs)
    settings = regions.SetSettings(rare_mac=rare_mac, ratios=score.Ratios(tuple(fit.ratios), tuple(fit.ratio_edges)))
    tests = score.TestSettings(fit.model.trait)
    rare = members.where(F.col("mac") > rare_mac).select("region", "marker_id").distinct()
    single = score.tested(filled.join(rare.select("marker_id").distinct(), "marker_id", "left_semi"), fit.sample_index, fit.model, tests, settings.ratios)
    names = markers.select("marker_id", F.concat_ws(":", "chrom", "pos", "ref", "alt").alias("name"))
    nothing = [F.lit(None).cast("string").alias("mask"), F.lit(None).cast("double").alias("max_maf")]
    columns = [f.split()[0] for f in score.RESULT.split(", ") if not f.startswith("marker_id")]
    single = single.join(rare, "marker_id").join(names, "marker_id").select("name", "region", *nothing, *columns)
    return single.union(regions.pseudo_markers(members, filled, fit.sample_index, fit.model, tests, settings).select("name", "region", "mask", "max_maf", *columns))


def _conditioning(fit: NullFit, dosages: DataFrame, markers: list) -> np.ndarray:
    """Dosages (n x c) of the markers to condition on: a few columns of the samples."""
    few = {r.marker_id: r for r in score.packed_markers(dosages.where(F.col("marker_id").isin(markers)), fit.sample_index).collect()}
    if absent := [m for m in markers if m not in few]:
        raise ValueError(f"conditioning markers that are absent: {absent}")
    block = np.zeros((len(fit.model.y), len(markers)))
    for k, m in enumerate(markers):
        block[few[m].idx, k] = few[m].dos
    return block


def create_relationship_matrix(calls: DataFrame, samples: DataFrame, n_samples: int, cutoff: float = 0.125, n_markers: int = 2000) -> DataFrame:
    between("cutoff", cutoff, 0, 1)
    return relationship.sparse_relationship(calls.where("dosage > 0"), samples, n_samples, cutoff, n_markers)


def ld(calls: DataFrame, groups: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Of minor alleles; `samples` are those without a row too, by default all that have any row."""
    samples = calls.select("sample_id").distinct() if samples is None else samples
    counts = qc.allele_counts(calls, samples.agg(F.count(F.lit(1)).alias("n")))
    return regions.ld_matrix(groups, qc.minor_dosages(calls, counts, samples))


def gene_effects(fit: NullFit, calls: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = calls.join(fit.sample_index.select("sample_id"), "sample_id", "left_semi")
    counts = qc.after_imputation(qc.allele_counts(g, calls.sparkSession.createDataFrame([(len(fit.model.y),)], "n long")))
    return effects.gene_effects(groups.join(counts.select("marker_id", "mac"), "marker_id"), qc.minor_dosages(g, counts, fit.sample_index), fit.sample_index, fit.model)

"""Marker and sample quality control, imputation, flips and weights.

Genotypes are long and sparse: (sample_id, marker_id, dosage) with null for a missing call and no row for
a zero. Counts of zeros come from the number of samples, so nothing dense is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelia.functions import special as S


def allele_counts(calls: DataFrame, n_samples: DataFrame) -> DataFrame:
    """Per marker: n_miss, missing, ac, af (of the counted allele), mac before imputation, maf.

    n_samples is a relation with one row and the column n.
    """
    per = calls.groupBy("marker_id").agg(F.sum("dosage").alias("ac"), F.count_if(F.col("dosage").isNull()).alias("n_miss")).crossJoin(F.broadcast(n_samples))
    per = per.withColumn("ac", F.coalesce("ac", F.lit(0.0))).withColumn("n_obs", F.col("n") - F.col("n_miss"))
    per = per.withColumn("af", F.when(F.col("n_obs") > 0, F.col("ac") / (2 * F.col("n_obs"))).otherwise(0.0)).withColumn("missing", F.col("n_miss") / F.col("n"))
    return per.withColumn("maf", F.least("af", 1 - F.col("af"))).withColumn("mac", F.col("maf") * 2 * F.col("n") * (1 - F.col("missing")))


FILLS = {"best_guess": lambda f: F.round(2 * f), "mean": lambda f: 2 * f, "minor": lambda f: F.lit(0.0)}


def impute_and_flip(calls: DataFrame, counts: DataFrame, fill: str = "best_guess") -> DataFrame:
    """Dosages of the minor allele: missing calls filled by the flipped frequency, allele flipped where af > 0.5.

    A flipped marker's zeros, which have no rows, become twos: `minor_dosages` adds them.
    """
    c = counts.select("marker_id", "af", F.least("af", 1 - F.col("af")).alias("f"), (F.col("af") > 0.5).alias("flip"))
    x = calls.join(c, "marker_id")
    g = F.when(F.col("dosage").isNull(), FILLS[fill](F.col("f"))).when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage"))
    return x.select("sample_id", "marker_id", "flip", "f", g.alias("g"))


def minor_dosages(calls: DataFrame, counts: DataFrame, samples: DataFrame, fill: str = "best_guess") -> DataFrame:
    """(sample_id, marker_id, dosage) of the minor allele, without zeros.

    Samples without a row have no copy of the counted allele: of a flipped marker (af > 0.5) they get 2. At least
    half of the samples have rows of such a marker, so this is no more than in proportion to the rows.
    """
    given = impute_and_flip(calls, counts, fill).select("sample_id", "marker_id", F.col("g").alias("dosage")).where("dosage > 0")
    flipped = counts.where("af > 0.5").select("marker_id")
    have = calls.join(flipped, "marker_id", "left_semi").groupBy("marker_id").agg(F.collect_set("sample_id").alias("have"))
    everyone = samples.agg(F.collect_set("sample_id").alias("everyone"))  # as long as the model's vectors
    absent = have.crossJoin(F.broadcast(everyone)).select(F.explode(F.array_except("everyone", "have")).alias("sample_id"), "marker_id", F.lit(2.0).alias("dosage"))
    return given.unionByName(absent)


def after_imputation(counts: DataFrame, fill: str = "best_guess") -> DataFrame:
    """counts with mac_post and maf_post: what imputation adds to the minor allele count."""
    added = FILLS[fill](F.col("maf")) * F.col("n_miss")
    x = counts.withColumn("mac_post", F.col("maf") * 2 * F.col("n_obs") + added)
    return x.withColumn("maf_post", F.col("mac_post") / (2 * F.col("n")))


def marker_filter(counts: DataFrame, max_missing: float, min_maf: float, min_mac: float, min_info: float = 0.0, info: Column | None = None) -> DataFrame:
    """First pass, before imputation."""
    keep = (F.col("missing") <= max_missing) & (F.col("maf") >= min_maf) & (F.col("mac") >= min_mac)
    return counts.where(keep & (info >= min_info) if info is not None else keep)


def second_filter(counts: DataFrame, min_maf: float, min_mac: float) -> DataFrame:
    return counts.where((F.col("maf_post") >= min_maf) & (F.col("mac_post") >= min_mac))


def region_filter(counts: DataFrame, max_missing: float, min_maf: float, min_mac: float, max_maf: float) -> DataFrame:
    """For set tests: once, after imputation, with an upper bound of the frequency."""
    return counts.where((F.col("missing") <= max_missing) & (F.col("maf_post") >= min_maf) & (F.col("mac_post") >= min_mac) & (F.col("maf_post") <= max_maf))


def relationship_markers(counts: DataFrame, min_maf: float = 0.01, max_missing: float = 0.15) -> DataFrame:
    return counts.where((F.col("maf_post") >= min_maf) & (F.col("missing") <= max_missing))


def hash_order(column: str, seed: int) -> Column:
    """A deterministic random order that any partitioning gives alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def marker_pool(counts: DataFrame, min_mac: float, n_draws: int, seed: int = 1, max_mac: float | None = None) -> DataFrame:
    """Markers to estimate variance ratios from: of a bounded random draw those with mac >= min_mac,
    and all of the rare class min_mac <= mac < max_mac if asked for."""
    common = counts.orderBy(hash_order("marker_id", seed)).limit(n_draws).where(F.col("mac") >= min_mac)
    if max_mac is None:
        return common
    return common.where(F.col("mac") >= max_mac).union(counts.where((F.col("mac") >= min_mac) & (F.col("mac") < max_mac)))


def random_markers(markers: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n markers without replacement."""
    return markers.orderBy(hash_order("marker_id", seed)).limit(n)


def case_control(calls: DataFrame, samples: DataFrame, outcome: str = "yb") -> DataFrame:
    """Per marker af, hom and het counts of cases and controls (outcome 1 and 0)."""
    totals = samples.agg(F.count_if(F.col(outcome) == 1).alias("n_case"), F.count_if(F.col(outcome) == 0).alias("n_ctrl"))
    x = calls.join(samples.select("sample_id", outcome), "sample_id")
    out = []
    for name, value in (("case", 1), ("ctrl", 0)):
        own = F.col(outcome) == value
        out += [
            F.sum(F.when(own, F.col("dosage")).otherwise(0.0)).alias(f"ac_{name}"),
            F.count_if(own & F.col("dosage").isNull()).alias(f"miss_{name}"),
            F.count_if(own & (F.col("dosage") >= 1.5)).alias(f"hom_{name}"),
            F.count_if(own & (F.col("dosage") >= 0.5) & (F.col("dosage") < 1.5)).alias(f"het_{name}"),
        ]
    y = x.groupBy("marker_id").agg(*out).crossJoin(F.broadcast(totals))
    for name in ("case", "ctrl"):
        y = y.withColumn(f"af_{name}", F.col(f"ac_{name}") / (2 * (F.col(f"n_{name}") - F.col(f"miss_{name}"))))
    return y.select("marker_id", "n_case", "n_ctrl", "af_case", "af_ctrl", "hom_case", "het_case", "hom_ctrl", "het_ctrl")


def imputation_info(dosages: DataFrame, n_samples: DataFrame) -> DataFrame:
    """1 - sum(f - e^2) / (2 n theta (1 - theta)) of genotype probabilities (p11, p10); 1 for theta 0 or 1."""
    e = 2 * F.col("p11") + F.col("p10")
    f = 4 * F.col("p11") + F.col("p10")
    x = dosages.groupBy("marker_id").agg(F.sum(e).alias("e"), F.sum(f - e * e).alias("v")).crossJoin(F.broadcast(n_samples))
    theta = F.col("e") / (2 * F.col("n"))
    return x.select("marker_id", F.when((theta <= 0) | (theta >= 1), 1.0).otherwise(1 - F.col("v") / (2 * F.col("n") * theta * (1 - theta))).alias("info"))


def zero_small_dosages(g: DataFrame, counts: DataFrame, mac_cutoff: float, cutoff: float) -> DataFrame:
    x = g.join(counts.select("marker_id", "mac"), "marker_id")
    return x.withColumn("dosage", F.when((F.col("mac") <= mac_cutoff) & (F.abs("dosage") <= cutoff), 0.0).otherwise(F.col("dosage"))).drop("mac")


def male_x(calls: DataFrame, samples: DataFrame, markers: DataFrame, par: DataFrame) -> DataFrame:
    """Doubles male dosages of markers outside the pseudo-autosomal ranges (start, stop; both inclusive)."""
    outside = markers.join(F.broadcast(par), F.col("pos").between(F.col("start"), F.col("stop")), "left_anti").select("marker_id").withColumn("outside", F.lit(True))
    x = calls.join(samples.select("sample_id", "male"), "sample_id").join(outside, "marker_id", "left")
    return x.select("sample_id", "marker_id", F.when(F.col("male") & F.col("outside"), F.col("dosage") * 2).otherwise(F.col("dosage")).alias("dosage"))


def sex_filter(samples: DataFrame, female_only: bool = False, male_only: bool = False) -> DataFrame:
    if female_only and male_only:
        raise ValueError("female_only and male_only exclude each other")
    return samples.where(~F.col("male")) if female_only else samples.where("male") if male_only else samples


def autosomes(markers: DataFrame, column: str = "chrom") -> DataFrame:
    number = F.expr(f"try_cast(regexp_replace(cast({column} AS string), '(?i)^chr', '') AS int)")
    return markers.where(number.between(1, 22))


def normal_chromosome(column: Column) -> Column:
    """Without a leading chr; numbers 1 to 22 as such, all else as text."""
    bare = F.regexp_replace(F.upper(column.cast("string")), "^CHR", "")
    digits = F.regexp_extract(bare, "^0*(\\d+)$", 1)
    return F.when(digits != "", digits).otherwise(bare)


def pre_censor(survival: DataFrame) -> DataFrame:
    """Without those censored before the first event."""
    first = survival.where("event = 1").agg(F.min("time").alias("first"))
    return survival.crossJoin(F.broadcast(first)).where("not (event = 0 and time < first)").drop("first")


def complete_cases(table: DataFrame, id_column: str, columns: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Phenotype rows with all needed columns, of the samples asked for; a missing column is an error."""
    missing = {id_column, *columns} - set(table.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    x = table.select(F.col(id_column).cast("string").alias("iid"), *columns).dropna()
    return x if ids is None else x.join(ids.select(F.col(ids.columns[0]).cast("string").alias("iid")).distinct(), "iid", "left_semi")


def separated_covariates(samples: DataFrame, outcome: str, covariates: list[str], least: int) -> list[str]:
    """Binary covariates of which a cell of the outcome table has fewer than `least` rows."""
    out = []
    for c in covariates:
        cells = samples.groupBy(outcome, c).count()
        if samples.select(c).distinct().limit(3).count() == 2:
            small = cells.where(F.col("count") < least).limit(1).count() or cells.count() < 4 and least > 0
            if small:
                out.append(c)
    return out


def inverse_sd(f: Column) -> Column:
    sd = F.sqrt(2 * f * (1 - f))
    return F.when(sd == 0, 0.0).otherwise(1 / sd)


def standardised(g: Column, f: Column) -> Column:
    return (g - 2 * f) * inverse_sd(f)


def beta_weight(maf: str, a: float = 1.0, b: float = 25.0) -> Column:
    return F.expr(S.beta_density_sql(maf, a, b))

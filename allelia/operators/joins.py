"""Joins of samples, markers, groups and ranges.

Small sides are broadcast by the optimiser's own size check; range joins run over bins of positions, so
they are equi-joins and neither side has to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 1 << 16


def aligned_samples(phenotypes: DataFrame, genotype_samples: DataFrame) -> DataFrame:
    """Phenotypes of genotyped samples with their place (sample_idx) in the genotype order."""
    return phenotypes.join(genotype_samples.select("sample_id", "sample_idx"), "sample_id")


def required(wanted: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a wanted key isn't there."""
    absent = wanted.join(available, key, "left_anti").limit(5).collect()
    if absent:
        raise ValueError(f"absent: {[r[key] for r in absent]}")
    return wanted.join(available, key)


def by_either_id(groups: DataFrame, markers: DataFrame) -> DataFrame:
    """Groups (region, snp, anno) with markers (id, id2, ...), matched by id or, failing that, by id2.

    The sides are shuffled: the size that the optimiser takes for ids put together from a file's columns is that of the
    columns as they lie there, a small part of what a broadcast of them would hold.
    """
    both = F.array(*[F.struct(F.col(c).alias("id"), F.lit(k).alias("rank")) for k, c in ((1, "id"), (2, "id2"))])
    ids = markers.select(F.explode(both).alias("i"), F.col("marker_id").alias("mid"), "chrom", "pos").select("i.id", "mid", "chrom", "pos", "i.rank")
    x = groups.join(ids.hint("merge"), F.col("snp") == F.col("id"))
    best = x.groupBy("region", "snp", "anno").agg(F.min(F.struct("rank", "mid", "chrom", "pos")).alias("b"))
    return best.select("region", "snp", "anno", F.col("b.mid").alias("marker_id"), F.col("b.chrom").alias("chrom"), F.col("b.pos").alias("pos"))


def include_ids(markers: DataFrame, ids: DataFrame) -> DataFrame:
    """Markers whose id or id2 is listed."""
    listed = ids.select(F.col(ids.columns[0]).alias("key")).distinct()
    x = markers.withColumn("key", F.explode(F.array_distinct(F.array("id", "id2"))))
    return x.join(listed, "key", "left_semi").drop("key").dropDuplicates(["marker_id"])


def include_ranges(markers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Markers inside any range (chrom, start, stop), both ends inclusive; each marker once."""
    m = markers.withColumn("bin", F.floor(F.col("pos") / BIN))
    r = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("stop") / BIN))))
    r = r.select(F.col("chrom").alias("r_chrom"), "start", "stop", F.col("bin").alias("r_bin"))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("bin") == F.col("r_bin")) & F.col("pos").between(F.col("start"), F.col("stop"))
    return m.join(r, on, "left_semi").drop("bin")


def in_listed_sites(markers: DataFrame, sites: DataFrame) -> DataFrame:
    """Markers at listed (chrom, pos, ref, alt)."""
    return markers.join(sites, ["chrom", "pos", "ref", "alt"], "left_semi")


def ratio_by_mac(counts: DataFrame, edges: list[float], ratios: list[float], column: str = "mac") -> DataFrame:
    """The variance ratio of each marker: bin k is (edges[k], edges[k + 1]], below the first and above the
    last edge the outer bins."""
    if len(ratios) != max(1, len(edges)):
        raise ValueError("as many ratios as bins")
    mac, out = F.col(column), F.lit(float(ratios[-1]))
    for edge, ratio in reversed(list(zip(edges[1:], ratios))):
        out = F.when(mac <= edge, float(ratio)).otherwise(out)
    return counts.withColumn("ratio", out)


def sample_pairs(related: DataFrame, model: DataFrame) -> DataFrame:
    """Entries (i, j, value) of a relationship matrix for the model's samples, by their model index."""
    m = model.select("sample_id", "sample_idx")
    x = related.join(m.select(F.col("sample_id").alias("i"), F.col("sample_idx").alias("row")), "i")
    return x.join(m.select(F.col("sample_id").alias("j"), F.col("sample_idx").alias("col")), "j").select("row", "col", "value")


def conditioning_markers(wanted: list, markers: DataFrame) -> DataFrame:
    """Markers by id or id2 in the order asked for (`place`); an unknown one is an error."""
    rows = markers.sparkSession.createDataFrame([(w, k) for k, w in enumerate(wanted)], f"key {dict(markers.dtypes)['id']}, place int")
    ids = markers.select(F.col("id").alias("key"), "marker_id", F.lit(1).alias("rank")).union(markers.select(F.col("id2").alias("key"), "marker_id", F.lit(2).alias("rank")))
    found = required(rows, ids, "key").groupBy("key", "place").agg(F.min(F.struct("rank", "marker_id")).alias("m"))
    return found.select("place", "key", F.col("m.marker_id").alias("marker_id"))


def in_masks(groups: DataFrame, masks: list[str]) -> DataFrame:
    """(region, mask, marker): an annotation belongs to a mask that names it between semicolons."""
    m = groups.sparkSession.createDataFrame([(x, t) for x in masks for t in x.split(";")], "mask string, anno string")
    return groups.join(F.broadcast(m), "anno").select("region", "mask", "marker_id").distinct()


def reordered(values: DataFrame, order: DataFrame, key: str) -> DataFrame:
    return values.join(order, key)


def merged_regions(sites: DataFrame) -> DataFrame:
    """Hull of the positions of each region on each chromosome."""
    return sites.groupBy("region", "chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))

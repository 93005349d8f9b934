"""Mask aggregation, combinations of p-values, windows, ordering and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelia.functions import special as S
from allelia.plans.storage import saved


def mask_members(members: DataFrame, counts: DataFrame, cutoffs: list[float]) -> DataFrame:
    """(region, mask, max_maf, marker_id, maf, mac): the nested, overlapping groups of set tests."""
    c = members.sparkSession.createDataFrame([(float(x),) for x in cutoffs], "max_maf double")
    x = members.join(counts.select("marker_id", "maf", "mac"), "marker_id")
    return x.join(F.broadcast(c), F.col("maf") <= F.col("max_maf"))


def mask_counts(members: DataFrame, calls: DataFrame, samples: DataFrame, outcome: str = "yb", rare_mac: float = 10.0) -> DataFrame:
    """Per mask: mac, mac_case, mac_ctrl, n_rare, n_ultra_rare."""
    s = samples.select("sample_id", (F.col(outcome) == 1).alias("case"))
    per = calls.join(s, "sample_id").groupBy("marker_id").agg(F.sum(F.when(F.col("case"), F.col("dosage")).otherwise(0.0)).alias("ac_case"), F.sum(F.when(~F.col("case"), F.col("dosage")).otherwise(0.0)).alias("ac_ctrl"))
    x = members.join(per, "marker_id")
    return x.groupBy("region", "mask", "max_maf").agg(
        F.sum(F.col("ac_case") + F.col("ac_ctrl")).alias("mac"),
        F.sum("ac_case").alias("mac_case"),
        F.sum("ac_ctrl").alias("mac_ctrl"),
        F.count_if(F.col("mac") > rare_mac).alias("n_rare"),
        F.count_if(F.col("mac") <= rare_mac).alias("n_ultra_rare"),
    )


def burden(members: DataFrame, g: DataFrame, weight: Column) -> DataFrame:
    """Weighted burden of each sample and mask."""
    x = members.withColumn("w", weight).join(g.where("dosage > 0"), "marker_id")
    return x.groupBy("region", "mask", "max_maf", "sample_id").agg(F.sum(F.col("w") * F.col("dosage")).alias("burden"))


def ultra_rare(members: DataFrame, g: DataFrame, rare_mac: float = 10.0) -> DataFrame:
    """The collapsed ultra-rare marker of each mask: per sample the largest dosage."""
    x = members.where(F.col("mac") <= rare_mac).join(g.where("dosage > 0"), "marker_id")
    return x.groupBy("region", "mask", "max_maf", "sample_id").agg(F.max("dosage").alias("dosage"))


def ultra_rare_capped(members: DataFrame, g: DataFrame, rare_mac: float) -> DataFrame:
    """The other way to collapse: the sum of dosages, at most 1."""
    x = members.where(F.col("mac") <= rare_mac).join(g.where("dosage > 0"), "marker_id")
    return x.groupBy("region", "sample_id").agg(F.least(F.sum("dosage"), F.lit(1.0)).alias("dosage"))


def sufficient_cutoffs(members: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Per region and mask the largest maf, and the first cutoff that takes all of the mask."""
    top = members.groupBy("region", "mask").agg(F.max("maf").alias("top"))
    c = members.sparkSession.createDataFrame([(float(x),) for x in cutoffs], "max_maf double")
    return top.join(F.broadcast(c), F.col("max_maf") >= F.col("top"), "left").groupBy("region", "mask", "top").agg(F.min("max_maf").alias("enough"))


def carried_forward(results: DataFrame, value: str) -> DataFrame:
    """Cutoffs above the sufficient one repeat the result of the one before."""
    w = Window.partitionBy("region", "mask").orderBy("max_maf").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn(value, F.last(value, ignorenulls=True).over(w))


def cauchy(p_values: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Cauchy combination per group; null p-values are left out, values outside of [0, 1] an error."""
    v = F.col(p)
    checked = F.when((v < 0) | (v > 1), F.raise_error(F.lit("p-values lie in [0, 1]"))).otherwise(v)
    term = F.when(v < 1e-16, 1 / (v * F.pi())).otherwise(F.tan((0.5 - v) * F.pi()))
    x = p_values.where(v.isNotNull()).withColumn(p, checked).groupBy(*by).agg(F.avg(F.when((v > 0) & (v < 1), term)).alias("stat"), F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    stat = F.col("stat")
    combined = F.when(stat > 1e15, 1 / (stat * F.pi())).otherwise(F.expr(S.cauchy_tail_sql("stat")))
    return x.select(*by, F.when(F.col("low") == 0, 0.0).when(F.col("high") == 1, F.least(F.lit(1.0), F.col("n") * F.col("low"))).otherwise(combined).alias("p_cauchy"))


def spread(values: DataFrame, column: str) -> DataFrame:
    """(sd / mean) / n: the stopping rule of Monte-Carlo estimates."""
    c = F.col(column)
    return values.agg((F.stddev_samp(c) / F.avg(c) / F.count(c)).alias("cv"), F.var_samp(c).alias("variance"), F.sum(F.when(F.isnan(c) | c.isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(c)).alias("finite_sum"))


def inverse_normal(samples: DataFrame, column: str = "y") -> DataFrame:
    """Rank-based inverse-normal transform with average ranks of ties; nulls stay null.

    Ranks need one total order: values are counted first, so only distinct values pass the one sorted task
    of a running sum, in range partitions.
    """
    counts = samples.where(F.col(column).isNotNull()).groupBy(column).count()
    ranked = running_sum(counts, column, "count", "upto").crossJoin(F.broadcast(counts.agg(F.sum("count").alias("n"))))
    rank = F.col("upto") - (F.col("count") - 1) / 2
    scored = ranked.select(column, ((rank - 0.5) / F.col("n")).alias("u")).withColumn("z", F.expr(S.normal_quantile_sql("u")))
    return samples.join(scored, column, "left")


def running_sum(table: DataFrame, order: str, value: str, out: str, descending: bool = False) -> DataFrame:
    """Inclusive running sum over the whole table in an order of distinct keys, without one task for all rows.

    Rows are range-partitioned, each partition sums its own, and partition totals (as many as there are
    partitions) are added.
    """
    key = F.desc(order) if descending else F.asc(order)
    parts = table.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    parts = saved(parts, "running-sum")  # the partition numbers must be the same for both readers
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return parts.withColumn(out, F.sum(value).over(w)).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def chromosome_ranges(markers: DataFrame) -> DataFrame:
    """First and last marker index (from 0, in chromosome and position order) of each chromosome."""
    per = markers.groupBy("chrom").count()
    w = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("upto", F.sum("count").over(w)).select("chrom", (F.col("upto") - F.col("count")).alias("first"), (F.col("upto") - 1).alias("last"))


def chunks(markers: DataFrame, size: int) -> DataFrame:
    """Chunk number of each marker within its chromosome."""
    w = Window.partitionBy("chrom").orderBy("pos", "marker_id")
    return markers.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def n_chunks(markers: DataFrame, size: int) -> DataFrame:
    return markers.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / size).alias("n_chunks"))


def merged_cutoffs(mafs: list[float], macs: list[float], n: Column) -> Column:
    """Sorted union of frequency cutoffs and those that count cutoffs make, mac / (2 n)."""
    made = F.array(*[F.lit(float(x)) for x in mafs], *[F.lit(float(x)) / (2 * n) for x in macs])
    return F.array_sort(F.array_distinct(made))


def top(results: DataFrame, k: int, *order: str) -> DataFrame:
    return results.orderBy(*order).limit(k)


def running_offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """(key, start, stop) of consecutive stretches."""
    x = running_sum(sizes, key, size, "stop")
    return x.withColumn("start", F.col("stop") - F.col(size)).select(key, "start", "stop")

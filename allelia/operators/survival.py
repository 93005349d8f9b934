"""Risk sets of survival outcomes: everything is a window over event times.

Events are first summed per distinct time, so the cumulative sums run over distinct times in range
partitions (`running_sum`), never over all samples in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.operators.aggregates import running_sum


def binned_time(samples: DataFrame, width: int, time: str = "time") -> DataFrame:
    low = samples.agg(F.min(time).alias("low"))
    return samples.crossJoin(F.broadcast(low)).withColumn("bin", (F.floor((F.col(time) - F.col("low")) / width) + 1).cast("long")).drop("low")


def risk_sets(samples: DataFrame) -> DataFrame:
    """Per distinct time: n_event, n, risk (sum of exp(eta) of those at risk), event_no (number of the
    last event time up to here), hazard (Breslow increments summed), d (sum of n_event / risk^2)."""
    per = samples.groupBy("time").agg(F.sum("event").alias("n_event"), F.count(F.lit(1)).alias("n"), F.sum(F.exp("eta")).alias("own"))
    x = running_sum(per, "time", "own", "risk", descending=True)
    x = x.withColumn("step", F.col("n_event") / F.col("risk")).withColumn("d_step", F.col("n_event") / (F.col("risk") * F.col("risk"))).withColumn("is_event", F.when(F.col("n_event") > 0, 1).otherwise(0))
    for value, out in (("step", "hazard"), ("d_step", "d"), ("is_event", "event_no"), ("n", "upto")):
        x = running_sum(x, "time", value, out)
    return x.select("time", "n_event", "n", "upto", "risk", "event_no", "hazard", "d")


def event_order(samples: DataFrame) -> DataFrame:
    """Per sample the 1-based place of its time: the first place of that time, which tied events share."""
    sets = risk_sets(samples)
    return samples.join(sets.select("time", (F.col("upto") - F.col("n") + 1).alias("place"), "event_no"), "time")


def working_values(samples: DataFrame) -> DataFrame:
    """mu = hazard exp(eta), weight W = mu and working response of one step of the Poisson form."""
    x = samples.join(risk_sets(samples).select("time", "hazard", "d"), "time").withColumn("mu", F.col("hazard") * F.exp("eta"))
    return x.withColumn("response", F.when(F.col("mu") > 0, F.col("eta") + (F.col("event") - F.col("mu")) / F.col("mu")).otherwise(F.col("eta")))


def information_product(samples: DataFrame, value: str) -> DataFrame:
    """(W - U) b: the Cox information times a vector.

    With risk-set sums R(t) and B(t) = sum over the risk set of exp(eta) b, the i-th element is
    exp(eta_i) * sum over event times t <= time_i of n_event(t) * (b_i / R(t) - B(t) / R(t)^2).
    """
    weighted = samples.withColumn("wb", F.exp("eta") * F.col(value))
    per = weighted.groupBy("time").agg(F.sum("event").alias("n_event"), F.sum(F.exp("eta")).alias("own"), F.sum("wb").alias("own_b"))
    x = running_sum(per, "time", "own", "risk", descending=True)
    x = running_sum(x, "time", "own_b", "risk_b", descending=True)
    x = x.withColumn("h", F.col("n_event") / F.col("risk")).withColumn("hb", F.col("n_event") * F.col("risk_b") / (F.col("risk") * F.col("risk")))
    for v, out in (("h", "hazard"), ("hb", "hazard_b")):
        x = running_sum(x, "time", v, out)
    y = samples.join(x.select("time", "hazard", "hazard_b"), "time")
    return y.withColumn("product", F.exp("eta") * (F.col("hazard") * F.col(value) - F.col("hazard_b")))

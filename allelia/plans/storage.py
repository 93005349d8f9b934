"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:  # on a cluster the warehouse is shared, a temporary folder is not
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        base = tempfile.mkdtemp(prefix="allelia-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/allelia-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

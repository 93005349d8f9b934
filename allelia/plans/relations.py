"""Sample, marker, genotype and phenotype relations.

The library's operators take these relations in long form, non-zero dosages only. `Proxy` derives them from
the star-schema tables, so that every operator runs on data of any scale: customers are samples, parts are
markers, what a customer bought of a part is a dosage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTOSOMES = 22


@dataclass(frozen=True)
class Proxy:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def samples(self) -> DataFrame:
        """sample_id, y (quantitative), yb (binary), x1, x2, male"""
        return self.table("customer").select(
            F.col("c_custkey").alias("sample_id"),
            F.col("c_acctbal").alias("y"),
            F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("yb"),
            (F.col("c_nationkey") / 25.0).alias("x1"),
            F.pmod("c_custkey", F.lit(2)).cast("double").alias("x2"),
            (F.pmod("c_custkey", F.lit(3)) == 0).alias("male"),
        )

    def markers(self) -> DataFrame:
        """marker_id, chrom (1 to 22), pos, ref, alt, region (a gene), anno"""
        size = F.pmod("p_size", F.lit(3))
        return self.table("part").select(
            F.col("p_partkey").alias("marker_id"),
            (1 + F.pmod(F.col("p_size") - 1, F.lit(AUTOSOMES))).cast("int").alias("chrom"),
            F.col("p_partkey").alias("pos"),
            F.lit("A").alias("ref"),
            F.lit("G").alias("alt"),
            F.col("p_brand").alias("region"),
            F.when(size == 0, "lof").when(size == 1, "missense").otherwise("synonymous").alias("anno"),
        )

    def genotypes(self, by_sample: bool = False) -> DataFrame:
        """sample_id, marker_id, dosage of all non-zero calls (1 or 2); by_sample deals them by sample, which serves joins on it"""
        bought = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        if by_sample:
            bought = bought.select("o_custkey", "l_partkey").repartition("o_custkey")
        return bought.groupBy(F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("marker_id")).agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("double").alias("dosage"))

    def calls(self) -> DataFrame:
        """genotypes with a null dosage where the call is missing"""
        return self.genotypes().withColumn("dosage", F.when((F.col("sample_id") * 31 + F.col("marker_id") * 17) % 97 != 0, F.col("dosage")))

    def survival(self) -> DataFrame:
        """sample_id, time (days), event (0 or 1), eta"""
        o = self.table("orders")
        best = o.groupBy(F.col("o_custkey").alias("sample_id")).agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("f"))
        return best.join(self.samples(), "sample_id").select("sample_id", F.datediff("f.o_orderdate", F.lit("1992-01-01")).cast("long").alias("time"), F.when(F.col("f.o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("event"), (F.col("x1") - F.col("x2") / 2).alias("eta"))


#: The same relations as common table expressions for the SQL that results are held against.
SQL = """
samples AS (SELECT c_custkey AS sample_id, c_acctbal AS y, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS yb,
  c_nationkey / CAST(25 AS DOUBLE) AS x1, CAST(c_custkey % 2 AS DOUBLE) AS x2, c_custkey % 3 = 0 AS male FROM customer),
markers AS (SELECT p_partkey AS marker_id, CAST(1 + (p_size - 1) % 22 AS INTEGER) AS chrom, p_partkey AS pos, 'A' AS ref, 'G' AS alt, p_brand AS region,
  CASE p_size % 3 WHEN 0 THEN 'lof' WHEN 1 THEN 'missense' ELSE 'synonymous' END AS anno FROM part),
genotypes AS (SELECT o_custkey AS sample_id, l_partkey AS marker_id, CAST(least(count(*), 2) AS DOUBLE) AS dosage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
calls AS (SELECT sample_id, marker_id, CASE WHEN (sample_id * 31 + marker_id * 17) % 97 <> 0 THEN dosage END AS dosage FROM genotypes),
survival AS (SELECT o_custkey AS sample_id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS time,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS event, x1 - x2 / 2 AS eta
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) o JOIN samples ON sample_id = o_custkey WHERE k = 1)
"""

"""Result tables and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.functions.special import format_p


def single_variant(results: DataFrame, markers: DataFrame, counts: DataFrame) -> DataFrame:
    """Columns of single-variant results; rows without a p-value are left out."""
    x = results.where(F.col("p").isNotNull()).select("marker_id", "beta", "se", "tstat", "var", "p").join(markers.select("marker_id", "chrom", "pos", "ref", "alt"), "marker_id").join(counts.select("marker_id", F.col("ac").alias("ac2"), F.col("af").alias("af2"), "missing"), "marker_id")
    return x.select(F.col("chrom").alias("CHR"), F.col("pos").alias("POS"), F.concat_ws(":", "chrom", "pos", "ref", "alt").alias("MarkerID"), F.col("ref").alias("Allele1"), F.col("alt").alias("Allele2"), F.col("ac2").alias("AC_Allele2"), F.col("af2").alias("AF_Allele2"), F.col("missing").alias("MissingRate"), F.col("beta").alias("BETA"), F.col("se").alias("SE"), F.col("tstat").alias("Tstat"), "var", F.col("p").alias("p_value"))


def single_variant_table(results: DataFrame, markers: DataFrame, counts: DataFrame, trait: str, groups: DataFrame | None = None, conditional: DataFrame | None = None, more: bool = False, imputation: bool = False) -> DataFrame:
    """All columns of single-variant results by trait; rows without a p-value are left out.

    For a binary or survival outcome p_value_NA (without the tail) and Is_SPA, and from `groups` (`qc.case_control`) frequencies
    and numbers of cases and controls (events and censored), with `more` also their genotype counts; N for a
    quantitative one. `conditional` adds the columns _c. With `imputation` markers have `info` in place of the missing rate.
    """
    tails = trait in ("binary", "survival")
    if tails and groups is None:
        raise ValueError("a binary or survival outcome needs the counts of its groups")
    x = results.where(F.col("p").isNotNull()).join(markers.select("marker_id", "chrom", "pos", "ref", "alt", *(["info"] if imputation else [])), "marker_id")
    x = x.join(counts.select("marker_id", F.col("ac").alias("ac2"), F.col("af").alias("af2"), "missing", F.col("n").alias("n_all")), "marker_id")
    columns = [F.col("chrom").alias("CHR"), F.col("pos").alias("POS"), F.concat_ws(":", "chrom", "pos", "ref", "alt").alias("MarkerID"), F.col("ref").alias("Allele1"), F.col("alt").alias("Allele2"), F.col("ac2").alias("AC_Allele2"), F.col("af2").alias("AF_Allele2")]
    columns.append(F.col("info").alias("imputationInfo") if imputation else F.col("missing").alias("MissingRate"))
    columns += [F.col("beta").alias("BETA"), F.col("se").alias("SE"), F.col("tstat").alias("Tstat"), F.col("var"), F.col("p").alias("p_value")]
    if tails:
        columns += [F.col("p_plain").alias("p_value_NA"), F.col("is_spa").alias("Is_SPA")]
    if conditional is not None:
        x = x.join(conditional.select("marker_id", *[F.col(c).alias(f"{c}_c") for c in ("beta", "se", "tstat", "var", "p", "p_plain")]), "marker_id", "left")
        columns += [F.col(f"{a}_c").alias(f"{b}_c") for a, b in (("beta", "BETA"), ("se", "SE"), ("tstat", "Tstat"), ("var", "var"), ("p", "p_value"))]
        columns += [F.col("p_plain_c").alias("p_value_NA_c")] if tails else []
    if not tails:
        return x.select(*columns, F.col("n_all").alias("N"))
    x = x.join(groups, "marker_id", "left")
    one, other = ("case", "ctrl") if trait == "binary" else ("event", "censor")
    columns += [F.col("af_case").alias(f"AF_{one}"), F.col("af_ctrl").alias(f"AF_{other}"), F.col("n_case").alias(f"N_{one}"), F.col("n_ctrl").alias(f"N_{other}")]
    if more:
        columns += [F.col(f"{kind}_{own}").alias(f"N_{name}_{kind}") for own, name in (("case", one), ("ctrl", other)) for kind in ("hom", "het")]
    return x.select(*columns)


def marker_lists(members: DataFrame, rare_mac: float = 10.0) -> DataFrame:
    """Rare and ultra-rare markers of each mask as sorted comma lists. A mask is a gene, so lists are short."""
    ids = lambda keep: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(keep, F.col("marker_id")))), lambda x: x.cast("string")))
    return members.groupBy("region", "mask", "max_maf").agg(ids(F.col("mac") > rare_mac).alias("rare_variants"), ids(F.col("mac") <= rare_mac).alias("ultra_rare_variants"))


def with_text_p(results: DataFrame) -> DataFrame:
    """p as text with its logarithm where it underflows; only at the sink."""
    text = F.udf(format_p, "string")
    return results.withColumn("p_text", text("p", "log_p"))


def write_partitions(results: DataFrame, path: str, by: str = "chrom") -> None:
    """Writes by chromosome; a rerun of some chromosomes replaces just those, which is how a run resumes."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_model(model, path: str, spark, loco: dict | None = None) -> None:
    """A null model as two tables by left-out chromosome (0: none): parameters and per-sample vectors. A rerun replaces them."""
    for chrom, m in {0: model, **(loco or {})}.items():
        one = [(chrom, m.trait, float(m.tau[0]), float(m.tau[1]), [float(a) for a in m.alpha], bool(m.converged))]
        spark.createDataFrame(one, "loco_chrom int, trait string, tau0 double, tau1 double, alpha array<double>, converged boolean").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("loco_chrom").parquet(f"{path}/parameters")
        rows = [(chrom, k, float(m.y[k]), float(m.mu[k]), float(m.residual[k]), float(m.eta[k]), float(m.weight[k]), float(m.offset[k]), [float(v) for v in m.x[k]]) for k in range(len(m.y))]
        spark.createDataFrame(rows, "loco_chrom int, sample_idx int, y double, mu double, res double, eta double, v double, offset double, x array<double>").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("loco_chrom").parquet(f"{path}/samples")


def read_model(spark, path: str, chrom: int = 0, samples: list[int] | None = None):
    """The model without a chromosome, or of some of its samples in their order."""
    import numpy as np

    from allelia.operators.nullmodel import NullModel

    p = spark.read.parquet(f"{path}/parameters").where(F.col("loco_chrom") == chrom).first()
    if p is None:
        raise ValueError(f"no model without chromosome {chrom}")
    rows = sorted(spark.read.parquet(f"{path}/samples").where(F.col("loco_chrom") == chrom).collect(), key=lambda r: r.sample_idx)
    if samples is not None:
        have = {r.sample_idx: r for r in rows}
        if absent := [k for k in samples if k not in have]:
            raise ValueError(f"samples that the model doesn't have: {absent[:5]}")
        rows = [have[k] for k in samples]
    v = lambda name: np.array([r[name] for r in rows], float)
    return NullModel(p.trait, (p.tau0, p.tau1), np.array(p.alpha), v("eta"), v("mu"), v("res"), v("v"), np.array([r["x"] for r in rows], float), v("y"), v("offset"), p.converged)

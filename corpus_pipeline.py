"""A corpus pipeline: five stages from documents to token ids, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from allelia.llm import common, decontaminate, exact_dedup, jaccard_join, langid, sentencepiece


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language (null, no letter, or a score below chance)."""
    return langid.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of five-word shingle sets with a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back."""
    return sentencepiece.encode(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("SentencePiece", token_ids),
]
#: Language identification is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is a Parquet table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs

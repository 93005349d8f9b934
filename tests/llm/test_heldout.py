"""Trained operators on the fold of `documents` that they did not learn from."""

import os

import pytest
from pyspark.sql import functions as F

from allelia.llm import queries as Q

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = Q.op9_language(spark, SF).where("held_out and lang_pred <> 'und'").join(docs.where("lang is not null"), "doc_id")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n


def test_quality_of_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").where("quality is not null")
    rows = Q.op7_quality(spark, SF).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 5 and len(bad) > 5
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.9 * len(good) * len(bad)

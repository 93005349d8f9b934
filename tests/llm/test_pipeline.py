"""The pipeline's stages take effect, each on all that its predecessor kept."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = {"en": "the house garden river of and was under over with stone light water bread morning".split(), "fr": "la maison jardin rivière de et était sous avec pierre lumière eau pain matin très".split()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    docs = [(k, text("en" if k % 2 else "fr", 60), "en" if k % 2 else "fr") for k in range(40)]
    item = text("en", 25)
    words = docs[3][1].split()
    near = " ".join([*words[:58], "other", "end"])
    docs += [(100, "12 34 !!", "en"), (101, None, "en"), (102, docs[5][1].replace(" ", "\n"), "en"), (103, near, "en"), (104, text("en", 30) + ". " + item.upper() + " " + text("en", 10), "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in kept.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
    everything = {i for i, *_ in docs}
    assert left[0] == everything - {100, 101}
    assert left[1] == left[0] - {102}
    assert left[2] == left[1] - {103}
    assert left[3] == left[2] - {104}
    assert left[4] == left[3] and kept.where("not round_trip").count() == 0


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, mark long, root long, sig long, first boolean"
    spark.createDataFrame([(1, "one two three four five six", 0)], "item_id long, text string, node long").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "en", "s", 1, 7, 7, 7, 7, True), (1, text, "en", "s", 1, 8, 8, 8, 8, False), (None, text + " x", "en", "s", 1, 9, 9, 9, 9, None), (1, "a text of its own", "en", "s", 1, 1, 1, 1, 1, True)]
    for given, want in ((rows[:0], 0), (rows, 2)):
        kept = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
        assert kept.count() == want

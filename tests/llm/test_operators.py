"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from allelia.llm import decontaminate, exact_dedup, html_extract, jaccard_join, langid, license_scan, packing, pii, quality, sentencepiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, slice int"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None, "clash", 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{k % 977}" for k in range(30_000))
EDGE = [None, "", " \n", "a b", "a  b", "A B c d e f g", LONG, LONG, LONG + " x", "?!"]


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, label))}


def near_copies(seed, n_groups=6, size=12):
    rng = random.Random(seed)
    out = list(EDGE)
    for _ in range(n_groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


def overlapping(seed, n_groups=150):
    """Windows of one random sequence of words a group, many of which nearly link."""
    rng = random.Random(seed)
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{k}" for k in range(rng.randrange(16, 60))]
        for _ in range(rng.randrange(2, 6)):
            a = rng.randrange(0, len(base) // 3)
            own = base[a : rng.randrange(a + len(base) // 2, len(base) + 1)]
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_join_of_overlapping_windows(spark, width, percent):
    texts = overlapping(width)
    got = jaccard_join.jaccard_components(frame(spark, texts).repartition(3), width=width, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, width, percent)


def test_sets_left_by_the_only_centre_of_an_entry_are_compared(spark):
    """a and b link; the windows c and d of a share entries with both, and may be their centre."""
    rng = random.Random(5)
    texts = []
    for _ in range(100):
        w = [f"w{rng.randrange(10**9)}" for _ in range(24)]
        texts += [" ".join(x) for x in (w[:22] + w[22:23], w[:22] + w[23:], w[:13], w[10:22])]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, texts), width=4, percent=85).collect()}
    assert all(got[k + 1] == k for k in range(0, len(texts), 4))
    assert got == {k: c for k, (_, c) in brute_components(texts, 4, 85).items()}


@pytest.mark.parametrize("frequent", [False, True])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, frequent):
    if frequent:  # every shingle that occurs twice is of class 2, then 3
        monkeypatch.setattr(jaccard_join, "ranks_and_classes", lambda counts: ((10 * (1 + counts).clip(0, 20)).astype("uint8"), __import__("numpy").array([30, 60])))
    texts = near_copies(11 + frequent)
    got = jaccard_join.jaccard_components(frame(spark, texts).repartition(5), width=4, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, 4, 85)


def test_jaccard_join_keeps_one_of_each_component(spark):
    texts = near_copies(20, 2)
    want = {c for _, c in brute_components(texts, 5, 80).values()}
    kept = jaccard_join.keep_one(frame(spark, texts))
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == frame(spark, []).columns


def test_near_copies_in_blocks_and_by_salted_centres(spark, monkeypatch):
    """A group whose sets mostly do not link with its centres, compared in many small blocks."""
    monkeypatch.setattr(jaccard_join, "CELLS", 200)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(60):
        own = list(base)
        for j in rng.sample(range(90), rng.choice([1, 2, 4, 5, 6])):
            own[j] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own[: 90 - k % 4]))
    got = jaccard_join.jaccard_components(frame(spark, texts).repartition(3), width=4, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, 4, 85)


def test_frequent_shingles_of_a_table_are_of_higher_classes():
    import numpy as np

    rank, edges = jaccard_join.ranks_and_classes(np.array([1] * 1000 + [40, 400], "int32"))
    assert rank[0] < edges[0] <= rank[1000] < edges[1] <= rank[1001]


def test_near_copies_of_rows_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    texts, ids = [a, a + " end", b, b, c, c, c, None, None, "", a], [1, 2, 2, 2, None, None, 9, 4, None, 4, 1]
    kept = jaccard_join.keep_one(frame(spark, texts, ids))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", a), ("2", b), ("9", c), ("4", ""), ("None", ""), ("4", "")])
    kept = jaccard_join.keep_one(frame(spark, [c, c, c + " end"], [None, None, None]))
    assert kept.count() == 1


def test_near_copies_of_one_short_text(spark):
    assert [r.doc_id for r in jaccard_join.keep_one(frame(spark, ["only three words"])).collect()] == [0]


def test_jaccard_join_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("weak", [{}, {"key_bits": 2, "sha_hex": 0, "capacity": 1}])
def test_exact_dedup_matches_brute_force(spark, weak):
    texts = [*EDGE, "ab", "a\tb", "a \x0bb ", "é", "é ", *["same text"] * 30]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, texts).repartition(3), **weak).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for k, t in enumerate(texts):
        group = [j for j in range(len(texts)) if norm[j] == norm[k]]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        r = got[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(group), keep == k, hashlib.sha256(norm[k].encode()).hexdigest())
    assert len(got) == len(texts)


def test_exact_dedup_of_an_empty_table_and_plan_without_python(spark):
    df = exact_dedup.exact_groups(frame(spark, []))
    assert df.collect() == []
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_drop_copies_keeps_all_columns(spark):
    kept = exact_dedup.drop_copies(frame(spark, EDGE))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8, 9] and "node" in kept.columns


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, None), (3, "..."), (4, "two words")], "item_id long, text string")
    texts = [*EDGE, "x The quick, brown fox JUMPS over that lazy dog again! y", "the quick brown cat leaps under the lazy cow again", "two or words", "zwei two words", LONG + " the quick brown fox jumps over the lazy dog again"]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame(spark, texts), items).collect()}
    n = len(EDGE)
    assert got == {(n, 1): 1, (n + 3, 4): 0, (n + 4, 1): 0}
    left = decontaminate.drop_contaminated(frame(spark, texts), items)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {n, n + 3, n + 4}
    assert decontaminate.contaminated(frame(spark, texts), items.limit(0)).collect() == []


def test_decontamination_of_other_scripts(spark):
    zh, th = "第二次世界大战是在哪一年结束的请回答", "ประเทศไทยมีเมืองหลวงชื่อว่าอะไร"
    quoted = "it's the \"ÉTÉ\" of the year - so we don't ask the STRASSE why"
    items = spark.createDataFrame([(1, zh), (2, th), (3, quoted), (4, "наука и жизнь в новом веке"), (5, "ideia única são três")], "item_id long, text string")
    texts = [
        "他问道" + zh + "。然后他走了",
        "他问道" + zh.replace("哪一年", "何年") + "。然后",
        "เขาถามว่า" + th + "แล้วเดินไป",
        "He wrote: it’s the “été” of the\u00a0year — so we don’t ask the straße why…",
        "Вот НАУКА И ЖИЗНЬ, В НОВОМ ВЕКЕ",
        "x IDEIA U\u0301NICA SA\u0303O\u200b TRÊS!",
        "他说今天天气很好。我们去公园",
        "the summer of the year",
    ]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame(spark, texts), items).collect()}
    assert got == {(0, 1): 0, (1, 1): 2, (2, 2): 0, (3, 3): 0, (4, 4): 0, (5, 5): 0}


def test_license_scan(spark):
    got = license_scan.scan(frame(spark, [*EDGE, LONG + " Released under the MIT License. " + LONG])).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(len(EDGE), "MIT", 1.0)]


def test_surrogates_and_their_distinctness(spark):
    texts = [*EDGE, *[f"mail user{k}@mail.example.com or +1 (555) 000-{k:04d} from 10.0.0.{k}" for k in range(100)]]
    got = {r.doc_id: r for r in pii.surrogates(frame(spark, texts), "k").collect()}
    assert all(got[k].text == t and got[k].n_entities == 0 for k, t in enumerate(EDGE))
    assert all(got[k].n_entities == 3 for k in range(len(EDGE), len(texts)))
    assert len({e.surrogate for r in got.values() for e in r.entities}) == 300
    assert pii.collisions(frame(spark, texts), "k").count() == 0


def test_collisions_of_names_are_found_and_reported(spark, monkeypatch):
    docs = frame(spark, [None, "", "Dr Ida Brown met Anna Miller.", "Dr Ana White said so, and Mr Green went."])
    assert {r.kind for r in pii.entity_map(docs, "k").collect()} == {"given", "family"}
    assert pii.entity_map(docs, "k").count() == 7 and pii.collisions(docs, "k").count() == 0
    got = pii.checked(docs, "k")
    assert got.drop("n_collisions").collect() == pii.surrogates(docs, "k").collect() and {r.n_collisions for r in got.collect()} == {0}
    monkeypatch.setattr(pii, "collisions", lambda docs, key: docs.limit(2))
    assert {r.n_collisions for r in pii.checked(docs, "k").collect()} == {2}


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(70)}
    rows = [(100 * k + i, " ".join(rng.choices(words[x], k=30)), x) for k, x in enumerate(words) for i in range(2 if k == 69 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.names == sorted(words)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == x and got[i].score > 0.3 for i, _, x in rows)


def test_encoding_round_trip(spark):
    texts = [*EDGE, "日本語 \U0001f600\n\n  tab\t"]
    rows = {r.doc_id: r for r in sentencepiece.encode(frame(spark, texts), keep_text=True).collect()}
    assert rows[0].ids is None and rows[1].ids == [] and all(r.round_trip for r in rows.values())
    back = sentencepiece.decode(spark.createDataFrame([(k, r.ids) for k, r in rows.items()], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    assert sentencepiece.encode(frame(spark, [])).count() == 0


def test_packing_is_lossless(spark):
    import numpy as np

    texts = [*EDGE, *["some words to pack " * k for k in range(60)]]
    rows = packing.pack(frame(spark, texts).coalesce(2), length=64, pool_rows=8).collect()
    tool, parts = packing.Tokenizer(packing.RANKS), {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, {})[offset] = ids[a:b].tolist()
    for k, t in enumerate(texts):
        joined = [i for _, x in sorted(parts[k].items()) for i in x]
        assert joined == [*tool.encoding.encode_ordinary(t or ""), tool.separator]
    assert len({r.pack_id for r in rows}) == len(rows)


def test_quality_and_language_of_edge_tables(spark):
    good, bad = "the quiet river ran past old houses and small gardens. ", "BUY!!! $$$ ### NOW*** %%% CLICK&&& "
    texts = [*EDGE, *[(good if k % 2 else bad) * (1 + k % 7) + str(k) for k in range(120)]]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, (k - len(EDGE)) % 2, 0) for k in range(len(EDGE), len(texts))] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].predicted == (k - len(EDGE)) % 2 for k in range(len(EDGE), len(texts)))
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == len(texts)
    und = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [und[k].lang_pred for k in (0, 1, 2, 9)] == ["und"] * 4 and und[5].lang_pred == "en"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.doc_id for r in langid.drop_rejected(docs).collect()} == set(range(len(texts))) - {0, 1, 2, 9}


def test_html_extraction_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 0), (2, "u", "<article><h1>Head</h1><p>One &amp; two.</p></article><footer>x</footer>", 0), (2, "v", "<p>", 0)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "Head One & two.", 15)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_filters_judge_rows_and_not_ids(spark):
    """Rows that share an id, or have none, with one of them to drop."""
    item = "the quick brown fox jumps over the lazy dog again"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [item, "a text of its own that stays", item, "another that stays", item], [1, 1, None, None, 3])
    left = decontaminate.drop_contaminated(docs, items)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", "a text of its own that stays"), ("None", "another that stays")] and left.columns == docs.columns
    docs = frame(spark, ["plain words of a text", "123", "", "more words of a text", None], [1, 1, None, None, None])
    assert sorted(r.text for r in langid.drop_rejected(docs).collect()) == ["more words of a text", "plain words of a text"]
    docs = frame(spark, ["same", "s a m e", "same", "unique", "same", "s\na m e", "s a\tm e", "unique", None, ""], [1, 5, 5, 5, None, 5, 5, 5, None, 7])
    kept = sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(docs).collect())
    assert len(kept) == 3 and kept[1:] == [("5", "unique"), ("7", "")] and kept[0][0] == "5" and len(kept[0][1]) == 7

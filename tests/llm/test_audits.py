"""Source divergence, centroid clustering and quality rules against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from allelia.llm import centroids, divergence, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, total long, block string, value long"
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, 7, "clash", 7) for r in rows], SCHEMA)


# ---------------------------------------------------------------- divergence
def brute_divergence(rows, least, top):
    lower = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    groups, in_docs, count = defaultdict(set), Counter(), Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(lower.get(c, c) for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in set(terms):
            in_docs[lang, t] += 1
        for t in terms:
            count[lang, source, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        v = len(kept)
        own = {s: [count[lang, s, t] for t in kept] for s in sources}
        total = [sum(own[s][k] for s in sources) for k in range(v)]
        p = lambda ns: [1 + 10**9 * (n + 5) // (sum(ns) + 5 * v) for n in ns]  # noqa: B023, E731
        for s in sources:
            ps, q = p(own[s]), p(total)
            pairs = [(-sum(abs(a - b) for a, b in zip(ps, p(own[o]))), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -f, k + 1) for k, (f, _, o) in enumerate(sorted(pairs))}
            terms = sorted((b - a, t.encode(), t) for a, b, n, t in zip(ps, q, own[s], kept) if n and a > b)
            out |= {(lang, s, "term", t, -f, k + 1) for k, (f, _, t) in enumerate(terms[:top])}
    return out


def spoken(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Wo", "é", "日本", "zz", "Aé") for b in "abcdefghijklm"]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])
        w = rng.choices(vocabulary, [1 + (hash_of(source, v) % 9) for v in vocabulary], k=rng.randrange(0, 40))
        rows.append((k, rng.choice([" ", "\n", "1", "_-"]).join(w) if rng.random() < 0.95 else None, lang, source))
    rows += [(1, "123 $ 4", "numbers", "x"), (1, None, "numbers", "y"), (None, "", "alone", "x"), *[rows[5]] * 20, (9, "Woa " * 30_000, "en", "long")]
    return rows


def hash_of(*x):
    return int(hashlib.md5(repr(x).encode()).hexdigest(), 16)


@pytest.mark.parametrize("blocks", [None, (3, 2)])
def test_divergence_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:  # tasks take their settings from the operator's module, which they import anew
        monkeypatch.setattr(divergence, "TERMS", blocks[0])
        monkeypatch.setattr(divergence, "GROUPS", blocks[1])
    rows = spoken(1)
    got = divergence.audit(frame(spark, rows).repartition(5), least=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 4, 3)
    assert {r[2] for r in got if r[0] == "numbers"} == {"pair"} and not [r for r in got if r[0] == "alone"]


def test_divergence_of_empty_tables(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    one = divergence.audit(frame(spark, [(1, "a", "en", "x"), (2, "b", "en", "y")])).collect()
    assert sorted(tuple(r) for r in one) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_probabilities_are_exact_for_large_counts():
    for n, total, v in [(0, 1, 1), (3, 10, 4), (10**14, 3 * 10**14, 10**6), (7, 10**15, 10**7), (5, 5, 1)]:
        assert divergence.probability(np.array([n]), total, v)[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_pair_sums_by_parts(monkeypatch):
    rng = np.random.default_rng(0)
    p, q = rng.integers(0, 10**9, (7, 30)), rng.integers(0, 10**9, (5, 30))
    want = np.array([[abs(a - b).sum() for b in q] for a in p])
    assert (divergence.pair_sums(p, q) == want).all()
    monkeypatch.setattr(divergence, "CELLS", 10)
    assert (divergence.pair_sums(p, q) == want).all() and divergence.pair_sums(p[:, :0], q[:, :0]).shape == (7, 5)


# ---------------------------------------------------------------- clustering
def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[place(v)[1]].append(v)
        for c, vs in own.items():
            centres[c] = [sum(x) // len(vs) for x in zip(*vs)]
    ended = [(i, *place(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in ended:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in ended)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, v string, cluster int")


def clustered(spark, rows, **k):
    return sorted((str(r.vec_id), *list(r)[1:]) for r in centroids.clustered(embeddings(spark, rows).repartition(4), **k).collect())


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 64))
    rows = [(k, (centre[k % 12] + rng.normal(size=64) * 0.2).tolist()) for k in range(160)]
    rows += [(200 + k, rows[3][1]) for k in range(90)] + [(5, rows[9][1]), (None, rows[8][1]), (None, rows[7][1])]  # a hot vector, repeated and null ids
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 63 + [None]), (303, [float("nan")] * 64), (304, [float("inf")] + [0.0] * 63), (305, [0.0] * 64)]
    assert clustered(spark, rows) == brute_clusters(rows)


def test_clusters_of_few_equal_and_large_vectors(spark):
    assert clustered(spark, []) == []
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.5] * 64)]
    assert clustered(spark, few) == brute_clusters(few)
    large = [(k, [float(x)] * 64) for k, x in enumerate((1e6, 1e6 + 1, -1e6, 3.0, 4.0))]
    assert clustered(spark, large, k=3) == brute_clusters(large, k=3)
    huge = clustered(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [3e38] * 64)], k=1)
    assert [r[2] for r in huge] == [None] * 3 and {r[4] for r in huge} == {None}


def test_bounds_never_exceed_distances_and_prune_separated_vectors():
    rng = np.random.default_rng(5)
    centre = rng.integers(-4000, 4000, (40, 64))
    v = centre[rng.integers(0, 40, 500)] + rng.integers(-30, 30, (500, 64))
    d = ((v[:, None] - centre[None]) ** 2).sum(axis=2)
    small, small_c = centroids.compressed(v), centroids.compressed(centre)
    assert (centroids.bounds(small, small_c) <= d).all()
    cluster, distance, done = centroids.nearest(v, small, centre, small_c)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all() and done < 2 * len(v)
    tied = np.repeat(centre[:1], 3, axis=0)
    assert (centroids.nearest(v, small, tied, centroids.compressed(tied))[0] == 0).all()


# ---------------------------------------------------------------- quality rules
def brute_measures(text):
    w = re.findall(WORD, text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def marked(seed=2):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a", "#$ é\n\n#$ é\n", "word " * 25, "é…\n" * 30, "x\r\nx\r\nx\n", " ".join(f"w{k % 977}" for k in range(30_000)), "日本語。" * 200]
    for _ in range(120):
        texts.append(rng.choice([" ", "\n", " \r\n", "  "]).join(f"w{rng.randrange(rng.choice([1, 3, 50]))}" for _ in range(rng.randrange(1, 120))))
    base = " ".join(f"b{k}" for k in range(12))
    for _ in range(40):  # overlapping and separate repeats
        texts.append(" ".join([base] + [f"x{rng.random()}" for _ in range(rng.randrange(9))] + [base] * rng.randrange(3)))
    return texts + texts[:20]


def test_measurements_match_brute_force(spark):
    texts = marked()
    rows = quality_rules.judged(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]).repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judged(frame(spark, [])).collect() == []


def test_windows_that_share_a_hash_are_compared_by_words(spark):
    from pyspark.sql import functions as F

    texts = [t for t in marked() if t and len(t) < 5000][:80]
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    one = lambda *x: F.lit(1).cast("long")  # noqa: E731  every window collides
    got = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]).select("doc_id", quality_rules.let(words, lambda w: quality_rules.repeated_words(w, one)).alias("n"))
    assert {r.doc_id: r.n for r in got.collect()} == {k: brute_measures(t)[4] for k, t in enumerate(texts)}


def test_policies_and_ablations_come_from_the_ledger(spark):
    rng = random.Random(7)
    failed = [rng.choice([0, 0, rng.randrange(1 << len(quality_rules.RULES)), 1 << rng.randrange(len(quality_rules.RULES))]) for _ in range(400)]
    ledger = spark.createDataFrame([(k, f) for k, f in enumerate(failed)], "doc_id long, failed long")
    for version, mask in quality_rules.POLICIES.items():
        rows = quality_rules.apply_policy(ledger, version).collect()
        assert all(r.kept == (not r.failed & (mask | quality_rules.BASE)) and r.policy == version for r in rows)
    for r in quality_rules.ablations(ledger).collect():
        mask, bit = quality_rules.POLICIES[r.policy] | quality_rules.BASE, quality_rules.BIT[r.rule]
        assert (r.n_docs, r.n_failed, r.n_only) == (400, sum(bool(f & bit) for f in failed), sum(f & mask == bit for f in failed))
        assert (r.n_kept, r.n_kept_without) == (sum(not f & mask for f in failed), sum(not f & mask & ~bit for f in failed))
        assert r.seen == np.bitwise_or.reduce(failed) and r.always == np.bitwise_and.reduce(failed)
    assert set(quality_rules.POLICIES) >= {1} and all(m & quality_rules.BASE == quality_rules.BASE for m in quality_rules.POLICIES.values())


def test_quality_rules_use_no_python(spark):
    plan = quality_rules.measured(frame(spark, [(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Exchange" not in plan

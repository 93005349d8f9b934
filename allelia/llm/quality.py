"""Quality classifier: histogram gradient-boosted trees over document statistics.

One scan makes the statistics of every whole text; the trees are grown on histograms of a bounded
sample of labelled rows (`max_rows`) and flattened into arrays, which score all rows level by level in
numpy. Null text counts as empty. Scores never see labels, lang, source or doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": [0x20, *range(9, 14)],
    "line": [10],
    "stop": b".!?",
    "comma": b",;:",
    "odd": b"#$%&*|<>{}[]\\^~=_+@",
    "quote": b"\"'`()",
    "high": range(0xC0, 256),
    "tail": range(0x80, 0xC0),
}
CLASS_NAMES = list(_CLASSES)
FEATURES = ["log_points", "log_words", "word_mean", "word_sd", "word_long", "word_short", "distinct", "top_word", "pair_distinct", "line_words", "line_distinct", "stop_per_word", "odd_per_word", *(f"share_{x}" for x in CLASS_NAMES)]


def class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8) + len(CLASS_NAMES)
    for k, name in enumerate(CLASS_NAMES):
        table[list(_CLASSES[name])] = k
    table[10] = CLASS_NAMES.index("line")
    return table


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(off) - 1
    table = class_table()
    kinds = table[raw]
    doc = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(doc * 16 + kinds, minlength=16 * n).reshape(n, 16).astype(float)
    counts[:, CLASS_NAMES.index("space")] += counts[:, CLASS_NAMES.index("line")]
    at = {x: counts[:, k] for k, x in enumerate(CLASS_NAMES)}
    points = np.diff(off) - at["tail"]
    safe = np.maximum(points, 1)
    starts, ends, bounds = C.words(raw, off)
    hashes = C.span_hashes(C.BYTE_VALUE[C.LOWER[raw]], starts, ends)
    size = (ends - starts).astype(float)
    tails = np.append(0, np.cumsum(kinds == CLASS_NAMES.index("tail")))
    size -= tails[ends] - tails[starts]
    words = np.diff(bounds)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    total = lambda x: np.bincount(owner, x, minlength=n)
    mean = total(size) / some
    sd = np.sqrt(np.maximum(total(size * size) / some - mean**2, 0))
    distinct, top, pairs, line_distinct = (np.zeros(n) for _ in range(4))
    breaks = np.flatnonzero(raw == 10)
    for k in range(n):
        own = hashes[bounds[k] : bounds[k + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            distinct[k], top[k] = len(times) / len(own), times.max() / len(own)
            pairs[k] = len(np.unique(own[1:] * C.LANE[2] + own[:-1])) / max(1, len(own) - 1)
    line_at = np.searchsorted(breaks, off)
    first = np.concatenate([off[:-1], breaks + 1])
    last = np.concatenate([off[1:], breaks])
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.append(first[order][1:], len(raw))
    lines = C.span_hashes(C.BYTE_VALUE[raw], first, np.maximum(last, first))
    line_from = line_at[:-1] + np.arange(n)
    line_to = line_at[1:] + np.arange(n) + 1
    for k in range(n):
        own = lines[line_from[k] : line_to[k]]
        line_distinct[k] = len(np.unique(own)) / max(1, len(own))
    columns = [np.log1p(points), np.log1p(words), mean, sd, total(size > 9) / some, total(size < 3) / some, distinct, top, pairs, words / (at["line"] + 1), line_distinct, at["stop"] / some, at["odd"] / some]
    return np.stack([*columns, *(at[x] / safe for x in CLASS_NAMES)], axis=1)


def scan(batches):
    for b in batches:
        raw, off = C.text_buffers(b.column(1))
        rows = [statistics(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in C.blocks(off)]
        rows = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k].astype(np.float32)) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])


SCHEMA = "doc_id long, " + ", ".join(f"{x} float" for x in FEATURES)


class Trees:
    """Boosted trees of one depth, as arrays: node k of a level has children 2k and 2k + 1 in the next."""

    def __init__(self, depth: int, rate: float, bins: int):
        self.depth, self.rate, self.bins = depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, n_trees: int, l2: float = 1.0, least: float = 5.0) -> Trees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])).astype(np.float32) for f in range(width)]
        codes = np.stack([np.searchsorted(self.edges[f], x[:, f], "left") for f in range(width)], axis=1).astype(np.int64)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(n, self.base)
        features, cuts, leaves = [], [], []
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth, np.int32), np.full(2**self.depth, np.inf, np.float32)
            for level in range(self.depth):
                here = 1 << level
                best, where = np.full(here, 1e-9), np.full((here, 2), -1)
                for f in range(width):
                    key = node * self.bins + codes[:, f]
                    gs = np.bincount(key, g, here * self.bins).reshape(here, -1).cumsum(axis=1)
                    hs = np.bincount(key, h, here * self.bins).reshape(here, -1).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                    gain = gain[:, : len(self.edges[f])]
                    if gain.shape[1]:
                        at = gain.argmax(axis=1)
                        top = gain[np.arange(here), at]
                        better = top > best
                        best[better], where[better, 0], where[better, 1] = top[better], f, at[better]
                for k in range(here):
                    if where[k, 0] >= 0:
                        feature[here + k], cut[here + k] = where[k, 0], self.edges[where[k, 0]][where[k, 1]]
                node = 2 * node + (x[np.arange(n), feature[here + node]] > cut[here + node])
            gs, hs = (np.bincount(node, v, 2**self.depth) for v in (g, h))
            leaf = self.rate * gs / (hs + l2)
            raw += leaf[node]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            raw += leaf[node - 2**self.depth]
        return 1 / (1 + np.exp(-raw))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 80, depth: int = 4) -> Trees:
    """Trees from (doc_id, quality) rows with a label of 0 or 1, at most about max_rows, drawn by a hash."""
    rows = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    n = rows.count()
    scale = 1 << 30
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < max_rows * scale // n)
    got = stats.join(rows, "doc_id").select("doc_id", "y", *FEATURES).toPandas().sort_values(["doc_id", "y"])
    x, y = got[FEATURES].to_numpy(np.float32), got["y"].to_numpy(float)
    if not len(x):
        x, y = np.zeros((2, len(FEATURES)), np.float32), np.array([0.0, 1.0])
    return Trees(depth, 0.2, 64).fit(x, y, trees)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; labels of the held-out fold are not read."""
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = C.saved(small.mapInArrow(scan, SCHEMA), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels.where(C.remainder("doc_id", fold) != held)))

    def run(batches):
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1) if b.num_rows else np.zeros((0, len(FEATURES)), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (C.remainder("doc_id", fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Language identification with string kernels.

Texts become letters in lower case with one space for everything between them. The kernel of two texts
is the number of character n-grams (2 to 4, hashed to 2**16 slots) that both hold, over the root of the
product of their numbers: a blended-spectrum presence kernel. Nystroem landmarks, a bounded number per
language, give the feature map K(x, L) W^(-1/2), and kernel ridge regression on it is solved once per
language against the rest. Scoring is a batched matrix product of presence rows with the landmark rows
and weights, which are multiplied out beforehand.

Fitting takes a documented, bounded sample (`per_language` rows a language, drawn by a hash of doc_id)
of the rows it may learn from; prediction reads every whole text. A text that is null or has no letter
is `und` with score 0. Every language of the rows is learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
ORDERS = (2, 3, 4)
ROWS_AT_ONCE = 64
_fold: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Per code point its lower-case letter, or a space if it is no letter."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def presence(texts: list[str]) -> np.ndarray:
    """A row of SLOTS booleans per text: the n-grams that it holds; no letter, no slot."""
    out = np.zeros((len(texts), SLOTS), bool)
    table = folded()
    for row, text in enumerate(texts):
        c = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = c == 32
        if len(c) > 1:
            c = c[~(gap & np.append(False, gap[:-1]))]
        if not (c != 32).any():
            continue
        c = np.concatenate([[32], c, [32]]).astype(np.uint32)
        h = c * np.uint32(0x9E3779B1)
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x85EBCA6B) + c[n - 1 :]
            if n in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out[row, x >> np.uint32(32 - SLOT_BITS)] = True
    return out


def rows_at_once(texts: list[str]):
    for lo in range(0, len(texts), ROWS_AT_ONCE):
        yield lo, texts[lo : lo + ROWS_AT_ONCE]


def sample_rows(batches):
    """mapInArrow over (lang, text): (lang, packed presence row)."""
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, part in rows_at_once(texts):
            bits = np.packbits(presence(part), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(langs[lo : lo + len(part)]), pa.array([x.tobytes() for x in bits])], names=["lang", "bits"])


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias = names, weights, bias

    @classmethod
    def fit(cls, langs: list[str], packed: np.ndarray, landmarks: int, ridge: float = 1e-3) -> Model:
        """packed: presence rows of the sample as bits, ordered by a hash; the first ones of a language are its
        landmarks. Rows are unpacked 128 at a time."""
        names = sorted(set(langs))
        at = {x: k for k, x in enumerate(names)}
        y = np.array([at[x] for x in langs], np.int64)
        if not names:
            return cls([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
        pick = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])

        def unit(bits: np.ndarray) -> np.ndarray:
            x = np.unpackbits(bits, axis=1).astype(np.float32)
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            return x

        # landmarks and rows are unpacked in turn: whole are only numbers of landmarks times landmarks
        marks = [pick[k : k + 512] for k in range(0, len(pick), 512)]
        blocks = [slice(k, k + 512) for k in range(0, len(packed), 512)]

        def products(bits: np.ndarray) -> np.ndarray:
            out = np.empty((len(bits), len(pick)))
            for m, part in enumerate(marks):
                own = unit(packed[part]).T
                for k in range(0, len(bits), 128):
                    out[k : k + 128, m * 512 : m * 512 + len(part)] = unit(bits[k : k + 128]) @ own
            return out

        value, vector = np.linalg.eigh(np.concatenate([products(packed[part]) for part in marks]))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        # each language weighs the same
        weight = 1 / np.bincount(y)[y]
        weight = weight / weight.mean()
        bias = np.array([2 * weight[y == k].sum() for k in range(len(names))]) / len(packed) - 1
        mean, gram, side = np.zeros(root.shape[1]), np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names)))
        for rows in blocks:
            feature = products(packed[rows]) @ root
            weighed = feature * weight[rows, None]
            mean += weighed.sum(axis=0) / len(packed)
            gram += weighed.T @ feature
            side += weighed.T @ (np.where(y[rows, None] == np.arange(len(names)), 1.0, -1.0) - bias)
        gram += ridge * len(packed) * np.eye(len(gram)) - len(packed) * np.outer(mean, mean)
        w = np.linalg.solve(gram, side)
        mixed, weights = (root @ w).astype(np.float32), np.zeros((SLOTS, len(names)), np.float32)
        for m, part in enumerate(marks):
            for k in range(0, len(part), 128):
                weights += unit(packed[part[k : k + 128]]).T @ mixed[m * 512 + k : m * 512 + min(k + 128, len(part))]
        return cls(names, weights, bias - mean @ w)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        rows = presence(texts)
        size = rows.sum(axis=1)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        f = (rows.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
        e = np.exp(4.0 * (f - f.max(axis=1, keepdims=True)))
        best = f.argmax(axis=1)
        score = (e / e.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]
        return [self.names[k] if n else "und" for k, n in zip(best, size)], np.where(size > 0, score, 0.0)


def fit(rows: DataFrame, per_language: int = 1000, landmarks: int = 64) -> Model:
    """Learn from (doc_id, lang, text) rows; those with null lang or text are no examples."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model.fit([], np.zeros((0, SLOTS // 8), np.uint8), landmarks)
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(scale))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, per_language * scale // n + 1))])
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    got = sample.mapInArrow(C.released(sample_rows), "lang string, bits binary").collect()
    got = [r for r in got if any(r.bits)]
    got.sort(key=lambda r: hash_of(r.bits))
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), SLOTS // 8)
    return Model.fit([r["lang"] for r in got], bits, landmarks)


def hash_of(data) -> int:
    import zlib

    return zlib.crc32(bytes(data))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, scores = [], []
            for _, part in rows_at_once(texts):
                x, s = own.predict(part)
                names += x
                scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.released(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """Fit on the rows outside the held-out fold, predict all."""
    left = C.remainder("doc_id", fold)
    model = fit(docs.where(left.isNull() | (left != held)).select("doc_id", "lang", "text"))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(C.remainder("doc_id", fold) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_rejected(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows that have a language: not `und`, and a score that is not below chance-like levels.

    Each row is judged by its own text, so repeated and null ids change nothing.
    """
    left = C.remainder("doc_id", 4)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(left.isNull() | (left != 2)).select("doc_id", "lang", "text")))
    at = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, part in rows_at_once([t or "" for t in b.column(at).to_pylist()]):
                names, scores = own.predict(part)
                keep[lo : lo + len(part)] = (np.array(names, object) != "und") & (scores >= min_score)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(C.released(run), docs.schema)

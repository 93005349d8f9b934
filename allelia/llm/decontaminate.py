"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are sequences of words (letters, their marks and digits of any script, NFC and case-folded);
a character of a script that is written without spaces is a word of its own, invisible format characters are
none. An item of m words may
differ from a passage by k = floor((100 - percent) * m / 100) word edits. It is cut into k + 1 pieces:
k edits leave at least one piece untouched, so every passage within the budget holds some piece as it
is. Piece hits are found over whole texts by hashed windows, and each hit is verified with Myers'
bit-parallel edit distance against the words around it.

An item shorter than `exact_below` words must occur without edits, an item without words never matches.
Null and empty texts match nothing. Repeated items and rows are reported one by one.
Items go to the executors in blocks of `BLOCK` items, whatever their number.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

BLOCK = 20_000


def _letters() -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return keep


LETTER = _letters()


def spaced(raw: np.ndarray) -> np.ndarray:
    """Bytes with everything but ASCII letters, digits and non-ASCII bytes blanked."""
    return np.where(LETTER[raw], C.LOWER[raw], np.uint8(32))


# Blocks of scripts written without spaces between words.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFD)]
GAP, INNER, OWN, NONE = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """Per code point: between words, part of a word, a word of its own, or as if it weren't there."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LMN":
            table[c] = INNER
        elif kind == "Cf" and c != 0x200B:
            table[c] = NONE
    for lo, hi in UNSPACED:
        table[lo : hi + 1][table[lo : hi + 1] == INNER] = OWN
    table[[*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]] = NONE
    return table


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def text_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and per text the range of its words."""
    if not len(raw) or raw.max() < 128:
        return C.word_hashes(spaced(raw), offsets)
    data = raw.tobytes()
    rows = [folded(data[a:b].decode(errors="replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    code = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    cuts = np.cumsum([0, *map(len, rows)])
    kind = kinds()[code]
    there = kind != NONE
    cuts = np.append(0, np.cumsum(there))[cuts]
    code, kind = code[there], kind[there]
    apart = np.ones(len(code) + 1, bool)  # whether a word ends before this character if there is one
    apart[1:-1] = (kind[1:] != INNER) | (kind[:-1] != INNER)
    apart[cuts] = True
    inside = kind != GAP
    starts, ends = np.flatnonzero(inside & apart[:-1]), np.flatnonzero(inside & apart[1:]) + 1
    values = np.where(code < 128, C.BYTE_VALUE[np.minimum(code, 127)], C.mix(code.astype(np.uint64) + C.BASE))
    return C.span_hashes(values, starts, ends), np.searchsorted(starts, cuts)


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(errors="replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    return text_words(raw, np.array([0, len(raw)], np.int64))[0]


def pieces(m: int, percent: int, exact_below: int) -> tuple[int, list[tuple[int, int]]]:
    """Error budget and the (start, end) of its k + 1 pieces."""
    k = 0 if m < exact_below else (100 - percent) * m // 100
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return k, list(zip(cuts[:-1], cuts[1:]))


def myers(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(smallest edit distance of the item to a substring of text, where the first such substring ends)."""
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        masks[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int, exact_below: int):
        self.items, self.budget = items, []
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for at, (_, item) in enumerate(items):
            k, parts = pieces(len(item), percent, exact_below)
            self.budget.append(k)
            for lo, hi in parts if len(item) else ():
                by_length[hi - lo][int(self.windows(item[lo:hi], hi - lo)[0])].append((at, lo))
        self.tables = {}
        for n, found in by_length.items():
            flags = np.zeros(1 << 20, bool)
            keys = np.array(list(found), np.uint64)
            flags[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables[n] = (flags, np.sort(keys), dict(found))

    @staticmethod
    def windows(hashes: np.ndarray, n: int) -> np.ndarray:
        count = len(hashes) - n + 1
        if count < 1:
            return np.zeros(0, np.uint64)
        total = np.zeros(count, np.uint64)
        for k, power in enumerate(C.powers(n)[0]):
            total += hashes[k : k + count] * power
        return C.mix(total)

    def hits(self, hashes: np.ndarray, bounds: np.ndarray):
        """(text, item, distance, first word, end word) of the best passage of each text and item."""
        place: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, (flags, keys, found) in self.tables.items():
            rolled = self.windows(hashes, n)
            at = np.flatnonzero(flags[(rolled >> np.uint64(44)).astype(np.int64)])
            near = np.searchsorted(keys, rolled[at])
            near[near == len(keys)] = 0
            at = at[keys[near] == rolled[at]]
            docs = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[docs + 1]
            for p, d in zip(at[inside].tolist(), docs[inside].tolist()):
                for item, lo in found[int(rolled[p])]:
                    place[d, item].add(p - lo)
        for (d, item), starts in place.items():
            words, k = self.items[item][1], self.budget[item]
            m, best = len(words), None
            done = -1
            for s in sorted(starts):
                lo, hi = max(int(bounds[d]), s - k), min(int(bounds[d + 1]), s + m + k)
                if hi <= done:
                    continue
                distance, end = myers(words, hashes[lo:hi])
                done = hi
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, lo + end - int(bounds[d]))
                    if distance == 0:
                        break
            if best:
                yield d, item, best[0], max(0, best[1] - m), best[1]


def scan(shared, percent: int, exact_below: int):
    def run(batches):
        matcher = Matcher(shared.value, percent, exact_below)
        for b in batches:
            raw, off = C.text_buffers(b.column(1))
            ids = b.column(0).to_pylist()
            out = []
            for lo, hi in C.blocks(off):
                part = raw[off[lo] : off[hi]]
                if len(part):
                    hashes, bounds = text_words(part, off[lo : hi + 1] - off[lo])
                    for d, item, distance, first, end in matcher.hits(hashes, bounds):
                        out.append((ids[lo + d], matcher.items[item][0], distance, len(matcher.items[item][1]), first, end))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 6)], names=["doc_id", "item_id", "distance", "n_words", "first_word", "end_word"])

    return run


def item_blocks(benchmark: DataFrame):
    """Blocks of at most BLOCK (item_id, words) of the benchmark."""
    block: list[tuple[int, np.ndarray]] = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, item_words(row.text)))
        if len(block) >= BLOCK:
            yield block
            block = []
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, exact_below: int = 5) -> DataFrame:
    """A row per document and test item whose passage it holds within the budget, with the best passage."""
    spark = docs.sparkSession
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(benchmark):
        found = small.mapInArrow(C.released(scan(spark.sparkContext.broadcast(block), percent, exact_below)), "doc_id long, item_id long, distance long, n_words long, first_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, exact_below: int = 5) -> DataFrame:
    """The rows that hold no test item, each judged by its own text: repeated and null ids change nothing."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def without(shared):
        def run(batches):
            matcher = Matcher(shared.value, percent, exact_below)
            for b in batches:
                raw, off = C.text_buffers(b.column(at))
                keep = np.ones(b.num_rows, bool)
                for lo, hi in C.blocks(off):
                    if off[hi] > off[lo]:
                        for d, *_ in matcher.hits(*text_words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])):
                            keep[lo + d] = False
                yield b.filter(pa.array(keep))

        return C.released(run)

    out = docs
    for block in item_blocks(benchmark):  # one scan: the blocks follow each other in a task
        out = out.mapInArrow(without(spark.sparkContext.broadcast(block)), docs.schema)
    return out

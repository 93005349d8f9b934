"""How far the sources of a language differ in their terms, over term-block dense matrices.

1. Terms are counted per (lang, source, term) in numpy: the terms of a block of texts are encoded as numbers by an exact
   dictionary, pairs (document, term) sorted, and one row per group and term leaves the block, combined before the
   shuffle. A language keeps the terms that enough of its documents hold.
2. The kept terms of a language are dealt by hash into blocks of about `TERMS`, its sources into blocks of about
   `GROUPS`. A tile is a dense int64 matrix of one source block by one term block; groups without a term have a
   probability there too.
3. A task that gets the tiles of two source blocks and one term block broadcasts all pairs of their rows against each
   other and adds the sums of absolute differences to the pair matrix of these source blocks; it sends a matrix on when it
   is done with its tiles. Partial matrices are summed by pair.
4. The tile of a source block with itself also gives the terms of each group that exceed the language, merged into a heap of
   the best `top` per group; the heaps of the tasks are merged by rank.

A hot source is one row of every tile, whatever its number of documents. The pairs of sources that come out are the
contract's result, not an intermediate one. Arithmetic is exact: the quotient floor(10**9 * a / d) is taken in three
steps of base 1000, which holds up to 9 * 10**15 occurrences.

Null text, lang and source are ''. Texts without terms count for their group all the same. A language without kept terms
has pairs of value 0 and no terms; a language of one source has no pairs. Equal values are ranked by item. Repeated rows
are documents of their own; doc_id is not used; very long texts are counted whole; an empty table gives an empty result;
other columns are not touched.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelia.llm import common as C

TERMS = 256
GROUPS = 128
SCALE = 10**9
PRIOR = 5
#: Numbers of a broadcast difference, and of the pair matrices that a task holds.
CELLS = 1 << 20
HELD = 1 << 22
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def block_counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of some texts and their groups: (group, term, occurrences, documents) and the terms that these numbers mean."""
    raw, off = C.text_buffers(texts)
    starts, ends, bounds = C.words(raw, off, LETTER)
    data = C.LOWER[raw[LETTER[raw]]]  # terms end to end
    ends = np.append(0, np.cumsum(ends - starts))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
    width = max(1, len(terms.dictionary))
    own = np.repeat(np.arange(len(texts)), np.diff(bounds)) * width + terms.indices.to_numpy()
    own, times = np.unique(own, return_counts=True)
    key = group[own // width] * width + own % width
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, first) if len(key) else times
    return key[first] // width, key[first] % width, n, np.diff(np.append(first, len(key))), terms.dictionary


def count_terms(batches):
    """mapInArrow over (lang, source, text): rows (lang, source, term, n, docs); the empty term stands for the group itself."""
    names = ["lang", "source", "term", "n", "docs"]
    for b in batches:
        lang, source = (pc.fill_null(b.column(k), "").dictionary_encode() for k in (0, 1))
        n_sources = max(1, len(source.dictionary))
        pair = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
        _, off = C.text_buffers(b.column(2))

        def rows(group, term, n, docs):
            return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(group // n_sources)), source.dictionary.take(pa.array(group % n_sources)), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=names)  # noqa: B023

        seen, docs = np.unique(pair, return_counts=True)
        yield rows(seen, pa.array([""] * len(seen), pa.string()), np.zeros(len(seen), np.int64), docs)
        for lo, hi in C.blocks(off, C.BATCH_BYTES):
            group, term, n, docs, spelled = block_counts(b.column(2).slice(lo, hi - lo), pair[lo:hi])
            for at in range(0, len(n), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield rows(group[part], spelled.take(pa.array(term[part])), n[part], docs[part])


def probability(n: np.ndarray, total, v) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)) for n <= total, exactly."""
    rest, below = np.asarray(n, np.int64) + PRIOR, np.maximum(np.asarray(total, np.int64) + PRIOR * np.asarray(v, np.int64), 1)
    out = np.zeros(np.broadcast_shapes(rest.shape, below.shape), np.int64)
    rest = np.broadcast_to(rest, out.shape)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all rows of p from all rows of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, q.size))
    for at in range(0, len(p), step):
        out[at : at + step] = np.abs(p[at : at + step, None] - q[None]).sum(axis=2)
    return out


class Tiles:
    """What a task keeps of its tiles: pair matrices by language and two source blocks, heaps by group."""

    def __init__(self, top: int):
        self.top, self.pairs, self.heaps, self.cells = top, {}, {}, 0

    def add(self, key, width: int, rows: list, terms) -> None:
        """One tile: rows (side, source, total, v, positions, counts), and for a block with itself (terms, totals, all, v)."""
        lang, _, low, high = key
        sides = []
        for side in (0, 1):
            own = sorted((r for r in rows if r[0] == side), key=lambda r: r[1])
            n = np.zeros((len(own), width), np.int64)
            for k, r in enumerate(own):
                n[k, r[4]] = r[5]
            total, v = (np.array([r[c] for r in own], np.int64)[:, None] for c in (2, 3))
            sides.append(([r[1] for r in own], n, probability(n, total, v)))
        (left, n, p), (right, _, q) = sides
        if low == high:
            right, q = left, p
        if (lang, low, high) in self.pairs:
            self.pairs[lang, low, high][2][:] += pair_sums(p, q)
        else:
            self.pairs[lang, low, high] = (left, right, pair_sums(p, q))
            self.cells += len(left) * len(right)
        if terms is not None and width:
            spelled, totals, everything, v = terms
            over = p - probability(totals, everything, v)[None]
            for k, source in enumerate(left):
                at = np.flatnonzero((n[k] > 0) & (over[k] > 0))
                if len(at) > self.top:  # with all that tie with the last
                    at = at[over[k, at] >= np.partition(over[k, at], -self.top)[-self.top]]
                own = [(-int(over[k, t]), spelled[t].encode(), spelled[t]) for t in at]
                self.heaps[lang, source] = heapq.nsmallest(self.top, self.heaps.get((lang, source), []) + own)

    def sent(self):
        """Rows (lang, source, part, item, value); what is sent is forgotten."""
        names, out = ["lang", "source", "part", "item", "value"], []
        for (lang, low, high), (left, right, sums) in self.pairs.items():
            i, j = np.triu_indices(len(left), 1) if low == high else (x.ravel() for x in np.indices(sums.shape))
            if len(i):
                out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(left).take(pa.array(i)), pa.array(["pair"] * len(i)), pa.array(right).take(pa.array(j)), pa.array(sums[i, j])], names=names))
        rows = [(lang, source, "term", item, -f) for (lang, source), heap in self.heaps.items() for f, _, item in heap]
        if rows:
            out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names))
        self.pairs, self.heaps, self.cells = {}, {}, 0
        return out


def tile_results(top: int):
    """mapInArrow over (lang, block, low, high, side, source, total, v, width, cells, terms), sorted by the first five."""

    def run(batches):
        tiles, key, width, rows, terms = Tiles(top), None, 0, [], None
        for b in batches:
            for r in b.to_pylist():
                own = (r["lang"], r["block"], r["low"], r["high"])
                if own != key:
                    if key is not None:
                        tiles.add(key, width, rows, terms)
                        if tiles.cells > HELD:
                            yield from tiles.sent()
                    key, width, rows, terms = own, r["width"], [], None
                cells = r["cells"] or []
                at, n = np.array([c["pos"] for c in cells], np.int64), np.array([c["n"] for c in cells], np.int64)
                if r["side"] < 0:
                    spelled = [""] * width
                    for k, t in zip(at.tolist(), r["terms"]):
                        spelled[k] = t
                    totals = np.zeros(width, np.int64)
                    totals[at] = n
                    terms = (spelled, totals, r["total"], r["v"])
                else:
                    rows.append((r["side"], r["source"], r["total"], r["v"], at, n))
        if key is not None:
            tiles.add(key, width, rows, terms)
        yield from tiles.sent()

    return C.released(run)


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """Per (lang, source) group: lang, source, part, item, value and rank, the distances from the language's other
    sources (part pair) and the terms most above the language (part term)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(C.released(count_terms), "lang string, source string, term string, n long, docs long")
    counts = C.saved(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    held = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    held = C.saved(held.select("lang", "term", "total"), "terms")
    groups = counts.where("term = ''").select("lang", "source")

    # per language: kept terms, their occurrences, and the numbers of blocks
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / GROUPS)).alias("source_blocks"))
    kept = held.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    langs = langs.join(kept, "lang", "left").select("lang", "source_blocks", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"))
    langs = C.saved(langs.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS))), "langs")
    block = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    terms = held.join(langs.select("lang", "term_blocks"), "lang").withColumn("block", block("term", "term_blocks"))
    terms = C.saved(terms.select("lang", "term", "total", "block", place.alias("pos")), "places")
    widths = terms.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("width"))

    # the rows of the tiles: every group in every term block of its language
    cells = counts.where("term <> ''").join(terms.select("lang", "term", "block", "pos"), ["lang", "term"])
    cells = cells.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("pos", "n")).alias("cells"), F.sum("n").alias("n"))  # a block of terms at most
    cells = C.saved(cells, "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    heads = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    heads = heads.select("lang", "source", "total", "v", "source_blocks", block("source", "source_blocks").alias("own"), F.explode(every("term_blocks")).alias("block"))
    heads = heads.join(cells.drop("n"), ["lang", "source", "block"], "left").withColumn("other", F.explode(every("source_blocks")))
    own = ["source", "total", "v", "cells", F.lit(None).cast("array<string>").alias("terms")]
    heads = heads.select("lang", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), *own)
    names = terms.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "total", "term"))).alias("x"))
    names = names.join(langs, "lang").withColumn("low", F.explode(every("source_blocks")))
    as_cells = F.transform("x", lambda c: F.struct(c["pos"].alias("pos"), c["total"].alias("n")))
    names = names.select("lang", "block", "low", F.col("low").alias("high"), F.lit(-1).alias("side"), F.lit("").alias("source"), F.col("all").alias("total"), "v", as_cells.alias("cells"), F.col("x.term").alias("terms"))
    key = ["lang", "block", "low", "high"]
    tiles = heads.union(names).join(widths, ["lang", "block"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    tiles = tiles.select(*key, "side", "source", "total", "v", "width", "cells", "terms")
    tiles = tiles.repartition(*key).sortWithinPartitions(*key, "side")
    found = C.saved(tiles.mapInArrow(tile_results(top), "lang string, source string, part string, item string, value long"), "found")
    C.discard(counts, held, langs, terms, cells)

    pairs = found.where("part = 'pair'").groupBy("lang", "part", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "part", "value", both.alias("x")).select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")

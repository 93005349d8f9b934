"""N-gram Jaccard self join by token-combination prefixes.

A document is the set of its distinct w-word shingles; two documents link when
100 * |A & B| >= percent * |A | B|.

1. One scan gives each text the hash of its whole set (equal sets are one node from here on) and
   counts all shingles of the corpus in a table of 2**24 counters, a bound that does not grow.
2. All shingles are ordered by (counted frequency, hash): any one order gives exact results, this one
   puts rare shingles first. A set of n shingles can lose at most e = floor((100 - percent) * n / 100)
   of them to a partner, so it is enough to index a prefix that e losses cannot empty. Shingles of the
   rare class are indexed alone (one loss kills one), those of frequent classes in combinations of k = 2
   or 3 within a subclass (p of them survive p - k losses), and the prefix is extended until
   sum(max(0, p - k + 1)) > e. Every index entry keeps its place: the losses that its prefix already
   bears before it.
3. Within the sets that share an entry all are compared with a few centres, sets that share most of their
   prefix with others. This joins most large groups of copies with as many comparisons as there are entries;
   the centres then leave the entries.
4. Entries whose sets still lie in different components are narrowed. The exact number of losses depends on
   both sizes (two sets of equal size lose half of what e allows), so entries are dealt by pairs of narrow
   size levels, as the smaller or the larger side, and kept only if their place is within the losses of that
   pair of levels. What is left of a group of near copies is then the entries of rare shingles: mostly
   nothing. The two sides of each remaining group are compared in blocks of at most about `CELLS` shingles,
   a block pair a task.
5. Sides are first compared by parity bits: sets are folded into bits, and sets differ in at least as many
   shingles as their bits do. Only sets with a possible partner on the other side are shipped and verified,
   and only links that join two components of a block pair come out, never pairs.

Verification intersects whole sets of 64-bit shingle hashes. Pairs inside a component cannot change the
result and are not compared.

Nulls and texts without words have no shingles and link with nothing. Equal rows share a node, ties of
frequency are broken by the hash, an empty table gives an empty result, other columns are not touched, rows
that share a doc_id are rows of their own. A very long text is one row with a larger set.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelia.llm import common as C

SLOTS = 1 << 24
MAYBE_BITS = 1 << 23
#: A shingle is of class 2 or 3 from this multiple of a count that chance alone does not give a counter.
CLASS_FROM = (1, 16)
CENTRES = 2
#: Logarithm of the width of a size level.
STEP = float(np.log(1.01))
#: Shingles of one side of a block pair.
CELLS = 1 << 19
NODE = np.uint64(0x7FFFFFFFFFFFFFFF)
#: Bytes of text and shingles that a step of a task takes.
BLOCK = 1 << 18
HELD = 1 << 18
#: What a counter of two bytes holds; tasks keep the rest apart.
COUNTER = 65535


def batch_sets(batch: pa.RecordBatch, width: int, text: int = 1):
    """(row, sorted distinct shingles) for the rows of a batch."""
    raw, off = C.text_buffers(batch.column(text))
    for lo, hi in C.blocks(off, BLOCK):
        hashes, bounds = C.word_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        for k, s in enumerate(C.shingles(hashes, bounds, width)):
            yield lo + k, s


def node_of(s: np.ndarray) -> int:
    """Identity of a shingle set, a non-negative 63-bit number."""
    with np.errstate(over="ignore"):
        x = np.array([np.sum(C.mix(s + C.LANE[3])) + np.uint64(len(s)) * C.LANE[7]], np.uint64)
    return int((C.mix(x) & NODE)[0])


def parity_bits(s: np.ndarray) -> bytes:
    """Parity of the shingles per bit, two bits a shingle at least, a power of two of 64 or more."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words of parity bits on a narrower width."""
    return bits if bits.shape[1] == words else np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def slot_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64)  # the top 24 bits


def scan(width: int):
    """mapInArrow over (doc_id, text, mark): a row per document (with the parity bits where its set is new to
    the task), then the partition's counter slices."""

    def run(batches):
        seen: set[int] = set()
        counts = np.zeros(SLOTS, np.uint16)
        beyond: dict[int, int] = {}  # of counters that have left two bytes, what they had
        held, n_held = [], 0

        def flush():
            nonlocal held, n_held
            if held:
                own = np.sort(np.concatenate(held))
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                slots = own[first]
                total = counts[slots] + np.diff(np.append(first, len(own)))
                for k in np.flatnonzero(total > COUNTER).tolist():
                    beyond[int(slots[k])] = beyond.get(int(slots[k]), 0) + int(total[k])
                    total[k] = 0
                counts[slots] = total
            held, n_held = [], 0

        def slices():
            size = SLOTS // C.SLICES
            for k, part in enumerate(np.split(counts, C.SLICES)):
                whole = part.astype(np.uint32)
                for slot, n in beyond.items():
                    if slot // size == k:
                        whole[slot % size] += n
                if whole.any():
                    yield k, zlib.compress(whole.tobytes(), 1)

        names = ["doc_id", "mark", "n", "node", "slice", "blob"]
        for b in batches:
            n, node, bits = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for row, s in batch_sets(b, width):
                if len(s):
                    n[row], node[row] = len(s), node_of(s)
                    if node[row] not in seen:
                        seen.add(int(node[row]))
                        bits[row] = parity_bits(s)
                    held.append(slot_of(s).astype(np.int32))
                    n_held += len(s)
                    if n_held > HELD:
                        flush()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(node), pa.nulls(b.num_rows, pa.int32()), pa.array(bits, pa.binary())], names=names)
        flush()
        for part, blob in slices():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=names)

    return C.released(run)


def ranks_and_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per counter its place in the order (a fine logarithm of the count) and the class edges on that scale."""
    scale = lambda x: np.round(10 * np.log2(1.0 + x)).clip(0, 255)
    rank = np.empty(len(counts), np.uint8)
    for k in range(0, len(counts), 1 << 18):
        rank[k : k + (1 << 18)] = scale(counts[k : k + (1 << 18)])
    mean = float(counts.sum(dtype=np.int64)) / len(counts)
    load = 8 + mean + 4 * mean**0.5  # what other shingles of the same counter may add
    return rank, np.array([int(scale(load * x)) for x in CLASS_FROM])


def subclasses(regime: int, percent: int) -> int:
    """Subclasses of a frequent class for sets of 4**regime to 4**(regime + 1) - 1 shingles.

    So few that a set of any size that links with those can bear its losses: 0 where single shingles must do.
    """
    return max(0, int(4**regime * (percent / 100) ** 2 - 1) // 6)


def regimes(n: int, percent: int) -> set[int]:
    """Size regimes of a set of n and of every size that can link with it."""
    low, high = -(-n * percent // 100), n * 100 // percent
    level = lambda x: (max(1, x).bit_length() - 1) // 2
    return set(range(level(low), level(high) + 1))


def entries(s: np.ndarray, rank: np.ndarray, edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of a set (hashes of single shingles and of combinations), and the place of each."""
    n = len(s)
    need = (100 - percent) * n // 100 + 1
    order = np.lexsort((s, rank))
    s, cls = s[order], np.searchsorted(edges, rank[order], "right") + 1
    n_rare = int(np.searchsorted(cls, 2))
    if n_rare >= need:  # the same for any regime
        return C.mix(s[:need] ^ C.LANE[8]), np.arange(need)
    sig, place = [], []
    for regime in regimes(n, percent):
        groups = subclasses(regime, percent)
        size = np.where(cls >= 3, 3, cls) if groups else np.ones(n, np.int64)
        own = np.where(size > 1, size * max(groups, 1) + (s % np.uint64(max(groups, 1))).astype(np.int64), -1)
        seen: dict[int, int] = {}
        before = np.zeros(n, np.int64)
        killed, end = 0, n
        for i in range(n):
            before[i] = killed
            if size[i] == 1:
                killed += 1
            else:
                seen[own[i]] = seen.get(own[i], 0) + 1
                killed += seen[own[i]] >= size[i]
            if killed >= need:
                end = i + 1
                break
        alone = np.flatnonzero(size[:end] == 1)
        sig.append(C.mix(s[alone] ^ C.LANE[8]))
        place.append(before[alone])
        for g in seen:
            at = np.flatnonzero(own[:end] == g)
            k = int(size[at[0]])
            if len(at) >= k:
                picks = np.array(list(itertools.combinations(range(len(at)), k)))
                mixed = C.mix(s[at] + (C.LANE[9] + np.uint64(k + 4 * regime)))
                sig.append(C.mix(mixed[picks].sum(axis=1, dtype=np.uint64)))
                place.append(before[at[picks[:, -1]]])
    sig, first = np.unique(np.concatenate(sig), return_index=True)
    return sig, np.concatenate(place)[first]


def signatures(s: np.ndarray, rank: np.ndarray, edges: np.ndarray, percent: int) -> np.ndarray:
    """The hashes under which a set is indexed."""
    return entries(s, rank, edges, percent)[0]


def index(width: int, percent: int, shared):
    """mapInArrow over (doc_id, text): rows (sig, node, size and place), each set once per task."""

    def run(batches):
        rank, edges = shared.value
        seen: set[int] = set()
        for b in batches:
            sig, node, place, size = [], [], [], []
            for _, s in batch_sets(b, width):
                if len(s) and (x := node_of(s)) not in seen:
                    seen.add(x)
                    got, at = entries(s, rank[slot_of(s)], edges, percent)
                    sig.append(got)
                    node.append(x)
                    place.append((len(s) << 31) + at.astype(np.int64))
                    size.append(len(got))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.repeat(np.array(node, np.int64), size)), pa.array(np.concatenate(place))], names=["sig", "node", "place"])

    return C.released(run)


def maybe_bits(batches):
    """mapInArrow over (node): slices of a bit table that holds at least these nodes."""
    bits = np.zeros(MAYBE_BITS, bool)
    for b in batches:
        bits[b.column(0).to_numpy() & (MAYBE_BITS - 1)] = True
    parts = list(C.packed_counts(np.packbits(bits)))
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["slice", "blob"])


def candidate_sets(width: int, shared):
    """mapInArrow over (doc_id, text): rows (node, set) of the nodes that the bit table may hold."""

    def run(batches):
        bits = np.unpackbits(shared.value)
        seen: set[int] = set()
        for b in batches:
            node, blob = [], []
            for _, s in batch_sets(b, width):
                if len(s) and bits[(x := node_of(s)) & (MAYBE_BITS - 1)] and x not in seen:
                    seen.add(x)
                    node.append(x)
                    blob.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], names=["node", "words"])

    return C.released(run)


class Side:
    """One side of a block pair: the sets that those of the other side are compared with."""

    def __init__(self):
        self.nodes, self.roots, self.sets, self.up = [], [], [], {}
        self.tokens = None

    def add(self, node: int, root: int, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(s)

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def linked(self, root: int, s: np.ndarray, percent: int) -> list[int]:
        """The nodes that a set links with, one of each component that is not yet joined with its own."""
        if self.tokens is None:
            self.sizes = np.array([len(x) for x in self.sets])
            tokens, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(tokens, kind="stable")
            self.tokens, self.owner, self.sets = tokens[order], owner[order], []
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        count = hi - lo
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        out = []
        for k in np.flatnonzero(100 * both >= percent * (self.sizes + len(s) - both)).tolist():
            x, y = self.top(self.roots[k]), self.top(root)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append(self.nodes[k])
        return out


def near(percent: int):
    """mapInArrow over (key, side, node, root, n, bits), sorted by key and side: the rows (key, side, node, root)
    that may link with one of the other side and of another component."""

    def run(batches):
        key, held, tables = None, [], None
        out = []

        def close():
            if tables:
                for _, at, _, _, _, hit in tables:
                    out.extend((key, 0, held[k][0], held[k][1]) for k in at[hit].tolist())

        for batch in batches:
            keys, sides, nodes, roots, sizes = (batch.column(k).to_numpy() for k in range(5))
            blobs = batch.column(5)
            for i in range(batch.num_rows):
                if keys[i] != key:
                    close()
                    key, held, tables = keys[i], [], None
                bits = np.frombuffer(blobs[i].as_buffer(), np.uint64)[None]
                if not sides[i]:
                    held.append((int(nodes[i]), int(roots[i]), int(sizes[i]), bits.copy()))
                    continue
                if tables is None:  # one table for each width
                    tables = []
                    for w in sorted({x[3].shape[1] for x in held}):
                        at = np.array([k for k, x in enumerate(held) if x[3].shape[1] == w])
                        tables.append((w, at, np.array([held[k][2] for k in at]), np.array([held[k][1] for k in at]), np.concatenate([held[k][3] for k in at]), np.zeros(len(at), bool)))
                found = False
                for w, _, n, root, table, hit in tables:
                    width = min(w, bits.shape[1])
                    apart = np.bitwise_count(folded(table, width) ^ folded(bits, width)).sum(axis=1, dtype=np.int64)
                    total = n + int(sizes[i])
                    can = (100 * (total - apart) >= percent * (total + apart)) & (root != roots[i])
                    hit |= can
                    found = found or bool(can.any())
                if found:
                    out.append((key, 1, int(nodes[i]), int(roots[i])))
            yield rows_of(out)
            out.clear()
        close()
        yield rows_of(out)

    def rows_of(out):
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "side", "node", "root"])

    return C.released(run)


def compare(percent: int):
    """mapInArrow over (key, side, node, root, words), sorted by key and side: the links that join components."""

    def run(batches):
        key, side = None, Side()
        for batch in batches:
            a, b = [], []
            keys, sides, nodes, roots = (batch.column(k).to_numpy() for k in range(4))
            words = batch.column(4)
            for i in range(batch.num_rows):
                if keys[i] != key:
                    key, side = keys[i], Side()
                s = np.frombuffer(words[i].as_buffer(), np.uint64)
                if not sides[i]:
                    side.add(int(nodes[i]), int(roots[i]), s.copy())
                elif side.nodes:
                    found = side.linked(int(roots[i]), s, percent)
                    a += [int(nodes[i])] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return C.released(run)


def sides(rest: DataFrame, percent: int) -> DataFrame:
    """(sig, low, high, side, node, n, root): entries dealt by the size levels of a pair's smaller (side 0) and
    larger set, where their place is within the losses that these sizes allow.

    A level's least size is taken a little too small at most, which can only keep more.
    """
    level = lambda x: F.floor(F.log(x) / STEP).cast("int")
    least = lambda x: F.greatest(F.lit(1), F.floor(F.exp(x * STEP) * (1 - 1e-9)).cast("long"))
    whole = lambda x, y: F.floor((x + (y - 1)) / y).cast("long")  # noqa: E731  rounds up
    n, smallest = F.col("n"), whole(F.col("n") * percent, 100)
    common = ["sig", "node", "n", "root"]
    own = level(n)
    up = rest.withColumn("high", F.explode(F.sequence(own, F.greatest(own, level(F.least("n_high", F.floor(n * 100 / percent)))))))
    partner = F.greatest(n, least(F.col("high")))
    up = up.where((F.col("place") <= n - whole((n + partner) * percent, 100 + percent)) & (100 * n >= percent * partner))
    down = rest.withColumn("low", F.explode(F.sequence(F.least(own, level(F.greatest("n_low", smallest))), own)))
    partner = F.least(n, F.greatest(least(F.col("low")), smallest))
    down = down.where(F.col("place") <= n - whole((n + partner) * percent, 100 + percent))
    return up.select(*common, own.alias("low"), "high", F.lit(0).alias("side")).union(down.select(*common, "low", own.alias("high"), F.lit(1).alias("side")))


def node_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, node) for all documents, and (node, root) for the nodes that have links.

    mark is a hash of the text: with doc_id it tells rows apart.
    """
    spark = docs.sparkSession
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marked = small.withColumn("mark", F.xxhash64("text"))
    scanned = C.saved(marked.mapInArrow(scan(width), "doc_id long, mark long, n long, node long, slice int, blob binary"), "scan")
    nodes = scanned.where("slice is null").select("doc_id", "mark", "n", "node")
    nodes._saved = scanned._saved
    counts = C.gathered(scanned.where("slice is not null").select("slice", "blob"), "uint32", "sum", SLOTS, "int32")
    order = spark.sparkContext.broadcast(ranks_and_classes(counts))
    del counts
    sigs = small.mapInArrow(index(width, percent, order), "sig long, node long, place long")
    # an entry of two rows is a pair: it must fit in size, and its places must be within the losses of these sizes
    n1, n2 = F.shiftright("p1", 31), F.shiftright("p2", 31)
    place = lambda p: F.col(p).bitwiseAND((1 << 31) - 1)
    most = F.floor(((n1 + n2) * percent + (99 + percent)) / (100 + percent)).cast("long")
    fits = (100 * n1 >= percent * n2) & (place("p1") <= n1 - most) & (place("p2") <= n2 - most)
    of = Window.partitionBy("sig")  # shuffles the entries once, for their counts and for themselves
    seen = sigs.select("*", F.min("node").over(of).alias("one"), F.max("node").over(of).alias("other"), F.min("place").over(of).alias("p1"), F.max("place").over(of).alias("p2"), F.count(F.lit(1)).over(of).alias("rows"))
    held = seen.where((F.col("one") < F.col("other")) & ((F.col("rows") > 2) | fits)).groupBy("sig", "node").agg(F.min("place").alias("place"))
    held = C.saved(held.select("sig", "node", F.shiftright("place", 31).alias("n"), place("place").alias("place")), "held")
    # how much of its set a node shares with others: the best centres share most
    bits = scanned.where("slice is null and blob is not null").groupBy("node").agg(F.max("n").alias("n"), F.first("blob").alias("bits"))
    share = held.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    bits = C.saved(bits.join(share, "node").select("node", "n", "bits", (F.col("degree") / F.col("n")).alias("share")), "bits")

    def close(rows: DataFrame) -> DataFrame:
        """The (key, side, node, root) rows that may link."""
        rows = rows.join(bits.select("node", "n", "bits"), "node").select("key", "side", "node", "root", "n", "bits")
        return C.saved(rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(near(percent), "key long, side int, node long, root long"), "close")

    def links(rows: DataFrame) -> DataFrame:
        """Links of (key, side, node, root) rows.

        A scan of the texts makes the sets of these nodes again, which are shuffled by node once and never written.
        """
        table = C.gathered(rows.select("node").distinct().mapInArrow(C.released(maybe_bits), "slice int, blob binary"), "uint8", "or", MAYBE_BITS // 8, "uint8")
        if not table.any():
            return spark.createDataFrame([], "a long, b long")
        some = spark.sparkContext.broadcast(table)
        sets = small.mapInArrow(candidate_sets(width, some), "node long, words binary").groupBy("node").agg(F.first("words").alias("words"))
        rows = rows.join(sets, "node").select("key", "side", "node", "root", "words")
        return C.saved(rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(compare(percent), "a long, b long").distinct(), "links")

    def blocks(cells):
        return F.greatest(F.lit(1), F.ceil(cells / CELLS)).cast("int")

    # all sets of an entry with its centres: the best one, and one of the best by chance
    noise = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / (1 << 20)
    best = [F.max(F.struct((F.col("share") * (1 - 0.1 * c * noise)).alias("h"), "node", "n")).alias(f"c{c}") for c in range(CENTRES)]
    centres = held.join(bits.select("node", "share"), "node").groupBy("sig").agg(*best, F.count(F.lit(1)).alias("size"))
    centres = centres.select("sig", "size", F.array_distinct(F.array(*[F.struct(f"c{c}.node", f"c{c}.n") for c in range(CENTRES)])).alias("own"))
    centres = centres.select("sig", (F.col("size") - F.size("own")).alias("left"), F.explode("own").alias("c"))
    centres = C.saved(centres.select("sig", "left", F.col("c.node").alias("centre"), F.col("c.n").alias("m")), "centres")
    pairs = held.join(centres, "sig").where(f"node <> centre and 100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = C.saved(pairs.groupBy("centre", "node").agg(F.max("n").alias("n")), "pairs")
    load = pairs.groupBy("centre").agg(blocks(F.sum("n")).alias("parts"))
    spread = pairs.join(load, "centre").select(F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("key"), F.lit(1).alias("side"), "node", F.col("node").alias("root"))
    first = load.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centre")
    first = first.select(F.xxhash64("centre", F.col("part").cast("long")).alias("key"), F.lit(0).alias("side"), F.col("centre").alias("node"), F.col("centre").alias("root"))
    begun = close(first.union(spread))
    C.discard(pairs)

    # a centre has been compared with all sets of its entries: it leaves them; two sets must be left to be compared
    open_ = centres.where("left > 1")
    rest = held.join(open_.select("sig").distinct(), "sig", "left_semi")
    entry = C.saved(rest.join(open_.select("sig", F.col("centre").alias("node")), ["sig", "node"], "left_anti"), "rest")
    C.discard(held, centres)
    found = links(begun)
    C.discard(begun)
    root = C.components(found)

    # what is left: entries with several components, in narrow size levels, block by block
    rest = entry.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("n").alias("n_low"), F.max("n").alias("n_high")).where("r1 < r2").drop("r1", "r2")
    several = C.saved(rest.join(mixed, "sig"), "mixed")
    C.discard(entry)
    dealt = C.saved(sides(several, percent), "sides")
    C.discard(several)
    cells = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    # many entries of near copies have the same sets: of those with equal (128-bit) fingerprints one is enough
    print_of = [F.bit_xor(F.xxhash64("node", "side", F.lit(k))).alias(f"f{k}") for k in (1, 2)]
    group = dealt.groupBy("sig", "low", "high").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), cells(0).alias("a"), cells(1).alias("b"), *print_of)
    group = group.where("r1 < r2 and a > 0 and b > 0").groupBy("low", "high", "a", "b", "f1", "f2").agg(F.min("sig").alias("sig"))
    group = group.select("sig", "low", "high", blocks(F.col("a")).alias("parts0"), blocks(F.col("b")).alias("parts1"))
    rows = dealt.join(group, ["sig", "low", "high"])
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("pair", F.explode(F.when(F.col("side") == 0, F.transform(every("parts1"), lambda x: F.struct(part("parts0").alias("i"), x.alias("j")))).otherwise(F.transform(every("parts0"), lambda x: F.struct(x.alias("i"), part("parts1").alias("j"))))))
    ended = close(rows.select(F.xxhash64("sig", "low", "high", "pair.i", "pair.j").alias("key"), "side", "node", "root"))
    C.discard(dealt, bits)
    more = links(ended)
    C.discard(ended)
    if more.limit(1).count():
        C.discard(root)
        root = C.components(found.union(more))
    return nodes, root


def placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, root) per document; root is null without shingles."""
    nodes, root = node_components(docs, width, percent)
    out = nodes.join(root, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    done = C.saved(out.select("doc_id", "mark", "n", "root"), "placed")
    C.discard(nodes, root)
    return done


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Rows with a null doc_id get the smallest id of their component, null if it has none.
    """
    rows = placed(docs, width, percent)
    first = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"))
    out = rows.join(first, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component one row stays, that with the smallest doc_id.

    Decisions hold for rows, told apart by doc_id and text: a row that shares its id with a copy stays. Null
    ids come last. Of rows with the same id and text one stays. Rows without words are no copies and all stay.
    """
    rows = placed(docs, width, percent).where("root is not null")
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("head")
    group = rows.groupBy("root").agg(head, F.count(F.lit(1)).alias("size")).where("size > 1")
    named = rows.join(group, "root").select("doc_id", "mark", (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))).alias("first"))
    decided = C.saved(named.groupBy("doc_id", "mark").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("copies")), "decided")
    return C.decided(docs, decided, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))

"""Tables, shared storage and byte-level numpy kernels that the operators share.

Python stages read Arrow batches straight from their buffers: texts are never turned into
Python strings where bytes will do, and every kernel works on a bounded block of bytes at a
time (a single longer text makes a block of its own).
"""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelia.plans.storage import shared_dir

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: cuts the lineage, survives lost executors.

    The shuffle files of the write go with it: nothing reads them again, and they would stay until the driver
    happens to collect garbage. That holds for the write alone: results that are fetched step by step still need theirs.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `saved` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(run):
    """A mapInArrow function that gives memory back when its task ends: workers live on for other stages.

    The session's Arrow batches become BATCH_BYTES at most (64 MB by default, which a worker holds several times).
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo: the folds of the held-out contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- Arrow buffers
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `limit` bytes; every row is in exactly one range."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


# ---------------------------------------------------------------- hashing
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LANE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, n.bit_length())
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of 64-bit values."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * LANE[15])


def words(raw: np.ndarray, offsets: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+, or of runs of the bytes `of`, and per text the range of its words."""
    inside = (~SPACE if of is None else of)[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words after lower-casing A-Z, and per text the range of its words."""
    starts, ends, bounds = words(raw, offsets)
    return span_hashes(BYTE_VALUE[LOWER[raw]], starts, ends), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingles of `width` words; with fewer words the whole sequence as one."""
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width if n >= width else 0):
        rolled += hashes[k : n - width + 1 + k] * LANE[k]
    rolled = mix(rolled)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif hi > lo:
            own = hashes[lo:hi] * LANE[: hi - lo]
            yield mix(own.sum(keepdims=True, dtype=np.uint64) + (np.full(1, hi - lo, np.uint64) * LANE[width]))
        else:
            yield np.zeros(0, np.uint64)


# ---------------------------------------------------------------- bounded corpus-wide counters
SLICES = 256


def packed_counts(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A counter table as compressed slices, so that no task needs the whole table."""
    for k, part in enumerate(np.split(counts, SLICES)):
        if part.any():
            yield k, zlib.compress(part.tobytes(), 1)


def add_slices(slot_bytes: str, many: str, out: str):
    """mapInArrow: add (or OR) slices of counter tables that the partitions made; rows (slice, blob) of type `out`."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(blob), slot_bytes)
                if k not in total:
                    total[k] = part.astype(np.int64) if many == "sum" else part.copy()
                elif many == "sum":
                    total[k] += part
                else:
                    total[k] |= part
        keys = sorted(total)
        done = [zlib.compress(np.minimum(total[k], np.iinfo(out).max).astype(out).tobytes(), 1) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(done, pa.binary())], names=["slice", "blob"])

    return run


def gathered(slices: DataFrame, slot_bytes: str, many: str, slots: int, out: str) -> np.ndarray:
    """One table of `slots` counters (a bound that does not depend on the data) on the driver, by one job."""
    done = slices.repartition(F.col("slice")).mapInArrow(released(add_slices(slot_bytes, many, out)), "slice int, blob binary")
    whole = np.zeros(slots, out)
    size = slots // SLICES
    for row in done.collect():  # SLICES compressed rows at most
        whole[row.slice * size : (row.slice + 1) * size] = np.frombuffer(zlib.decompress(bytes(row.blob)), out)
    return whole


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b): smallest node id that links reach.

    Hash-to-min with pointer jumping; every round is written to the shared folder, and the
    number of rounds grows with the logarithm of the longest chain. Labels only ever fall, so it ends.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        nxt = saved(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was"), "label")
        moved = nxt.where("root <> was").limit(1).count()
        discard(label)
        label = nxt.select("node", "root")
        label._saved = nxt._saved
        if not moved:
            discard(both)
            return label


# ---------------------------------------------------------------- decisions on rows
def decided(docs: DataFrame, rows: DataFrame, mark) -> DataFrame:
    """The rows of docs that a decision lets stay, whole.

    `rows` has (doc_id, mark, first, copies): rows of that doc_id and mark go unless `first`, and of `copies`
    that cannot be told apart by these one stays (the least by all its columns). What it doesn't name stays.
    """
    columns = docs.columns
    at = "allelia mark"
    marked = docs.withColumn(at, mark)
    same = lambda r: r["doc_id"].eqNullSafe(marked["doc_id"].cast("long")) & (r["mark"] == marked[at])
    gone = rows.where("not first or copies > 1").select("doc_id", "mark")
    out = marked.join(gone, same(gone), "left_anti").select(columns)
    again = rows.where("first and copies > 1").select("doc_id", "mark")
    if again.limit(1).count():
        again = marked.join(again, same(again), "left_semi")
        one = again.groupBy(F.col("doc_id").alias("i"), at).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"))
        out = out.union(one.select([F.col("row")[c].alias(c) for c in columns]))
    return out

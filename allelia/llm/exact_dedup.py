"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations only.

* Scan: each text gives an index entry (64-bit key, SHA-256, bytes, code points) in a shared table.
* Directory: it starts with one bucket and doubles while a bucket holds more distinct keys than its
  capacity, up to 2**MAX_DEPTH slots (a bound that does not grow with the data; buckets that are
  still overfull then keep longer chains). Slot = leading key bits; several slots can share a bucket.
* Owners: texts are dealt by (bucket, key, text) and their bytes compared; copies are combined before the
  shuffle, so a group that holds a third of all rows is a few rows there. The finished entries are then dealt
  by ranges of (bucket, key), sorted, and written to the shared index, a file a range: an owner task has whole
  chains of its key range.
* Chains whose entries cannot be told apart without their bytes are resolved by joining on the bytes;
  all others by (key, SHA-256, length).

Null text counts as empty. Of equal texts the row with the most code points in the original text, then
the smallest doc_id stays; `kept` says that a row has that id. Repeated doc_ids are rows like any other, an
empty table gives an empty result, very long texts are compared whole, other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

MAX_DEPTH = 14
SPACES = " \t\n\u000b\u000c\r"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def directory(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) for each of the 2**depth slots, by doubling and splitting."""
    buckets = {(0, 0): sum(counts.values())}
    held = {(0, 0): dict(counts)}
    level = 0
    while level < depth and any(n > capacity and d == level for (_, d), n in buckets.items()):
        level += 1  # the directory doubles
        for key in [k for k, n in buckets.items() if n > capacity and k[1] == level - 1]:
            slots = held.pop(key)
            del buckets[key]
            for bit in (0, 1):
                own = {s: n for s, n in slots.items() if (s >> (depth - level)) & 1 == bit}
                new = (key[0] * 2 + bit, level)
                buckets[new], held[new] = sum(own.values()), own
    out = []
    for (prefix, d), _ in sorted(buckets.items(), key=lambda x: x[0][0] << (depth - x[0][1])):
        first = prefix << (depth - d)
        out += [(s, first, d) for s in range(first, first + (1 << (depth - d)))]
    return out


def slot(key, depth: int):
    return F.shiftrightunsigned(key, 64 - depth)


def exact_groups(docs: DataFrame, capacity: int = 4096, depth: int = MAX_DEPTH, key_bits: int = 64, sha_hex: int = 64) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, and for drop_copies row_mark (a hash
    of the original text) and first (whether a row of that doc_id and text stays).

    key_bits and sha_hex weaken the hashes, so that tests can make every chain collide.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("norm", normalised(F.col("text")))
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    rows = rows.withColumn("key", key)
    entries = C.saved(
        rows.select(
            "doc_id",
            "key",
            F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.octet_length("norm").alias("n_bytes"),
            F.char_length("text").cast("long").alias("n_points"),
            F.xxhash64("text").alias("row_mark"),
        ),
        "entries",
    )
    mark = ["key", "mark", "n_bytes"]
    entries = entries.withColumn("mark", F.substring("sha", 1, sha_hex))
    keys = entries.groupBy("key").agg(F.lit(1).alias("one")).groupBy(slot(F.col("key"), depth).alias("slot")).count()
    slots = directory({r["slot"]: r["count"] for r in keys.collect()}, depth, capacity)
    slots = spark.createDataFrame(slots, "slot long, bucket long, local_depth int")

    # owners: whole chains with their bytes
    weak = F.substring(F.sha2(F.col("norm").cast("binary"), 256), 1, sha_hex)
    owned = rows.select("key", "norm").join(F.broadcast(slots), slot(F.col("key"), depth) == F.col("slot"))
    chains = owned.groupBy("bucket", "key", "norm").agg(F.count(F.lit(1)).alias("n"))
    chains = chains.select("bucket", "key", weak.alias("mark"), F.octet_length("norm").alias("n_bytes"), F.hash("norm").alias("h"), "n")
    index = C.saved(chains.groupBy("bucket", *mark).agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("links")).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")

    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("back"), "row_mark")).alias("best")
    plain = entries.groupBy(*mark).agg(best)
    heads = index.join(plain, mark).where("links = 1").select(*mark, "bucket", "group_size", "best")
    out = entries.join(heads, mark)
    # every row of a chain that needs its bytes: normally there is none
    unclear = index.where("links > 1").select("bucket", *mark)
    if unclear.limit(1).count():
        full = rows.select("doc_id", "key", "norm", weak.alias("mark"), F.octet_length("norm").alias("n_bytes"), F.char_length("text").cast("long").alias("n_points"), F.xxhash64("text").alias("row_mark"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
        full = full.join(unclear, mark)
        group = full.groupBy(*mark, "norm").agg(best, F.count(F.lit(1)).alias("group_size"))
        more = full.join(group, [*mark, "norm"])
        columns = ["doc_id", "best", "group_size", "sha", "bucket", "n_points", "row_mark"]
        out = out.select(columns).union(more.select(columns))
    keep_id = -F.col("best.back")
    first = (F.col("n_points") == F.col("best.n_points")) & F.col("doc_id").eqNullSafe(keep_id) & (F.col("row_mark") == F.col("best.row_mark"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "row_mark", first.alias("first"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of every group of equal texts, whole.

    Rows are told apart by doc_id and original text, so a row that shares its id with a copy stays. Null ids come
    last; of rows with the same id and text one stays.
    """
    rows = exact_groups(docs).where("group_size > 1").groupBy("doc_id", F.col("row_mark").alias("mark"))
    found = C.saved(rows.agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("copies")), "decided")
    return C.decided(docs, found, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))

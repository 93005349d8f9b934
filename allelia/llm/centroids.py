"""Clustering of integer vectors around k centroids, with block-norm screening.

Each kept vector is stored once with its compressed form: per segment of 8 components the mean and the norm of what the
mean leaves. For two vectors a segment's squared distance is 8 times the squared difference of the means plus that of
the rests, and by Cauchy-Schwarz the rests are at least as far apart as their norms. Summed over the segments this gives
a lower bound from 16 instead of 64 numbers. A batch gets the bounds of all centroids by two small matrix products'
worth of work, the exact distance of the centroid with the least bound, and then, centroid by centroid, exact integer
distances only where the bound does not exceed the best exact distance so far. Bounds are taken a little lower than
computed, so rounding can't prune; equal distances are never pruned by a bound, so ties go to the smaller number.

A round ships the k x dim sums and counts of each task, and k x dim exact numbers reach the driver. A hot group of copies
is a number of rows like any other: rows are never grouped by content.

Kept are vectors of exactly `dim` components, none null or non-finite; a component x becomes floor(scale * x), at the ends
of the range of a long where it would leave it. Distances and their sums that leave that range are null (the cluster is
exact all the same). A null vec_id counts as an empty text in the order of the first centroids; equal hashes (repeated
ids) are ordered by their vectors. Fewer vectors than k give fewer centroids, an empty table gives an empty result. Repeated
rows are rows of their own; other columns are not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

SEGMENT = 8
#: Components below this bound in absolute value have distances that fit in a long.
NARROW = 1 << 27
ROWS = 4096


def integer_vectors(table: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the kept vectors."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.where(x.isNotNull() & (F.size(x) == dim)).where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def compressed(v: np.ndarray) -> np.ndarray:
    """Per row and segment the mean, scaled by the root of the segment's width, and the norm of the rest."""
    parts = v.astype(np.float64).reshape(len(v), v.shape[1] // SEGMENT, SEGMENT)
    mean = parts.mean(axis=2)
    rest = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return np.concatenate([mean * SEGMENT**0.5, rest], axis=1)


def bounds(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of all squared distances from the compressed forms, with room for rounding."""
    a, b = (x.astype(np.float64) for x in (vectors, centroids))
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
    return np.maximum(size - 2 * (a @ b.T) - 1e-9 * size - 1, 0)


def exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v from c (one row, or one per row), in the integers of v's type."""
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart) if apart.dtype != object else (apart * apart).sum(axis=1)


def nearest(v: np.ndarray, small: np.ndarray, centroids: np.ndarray, small_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of each row, and how many exact distances were computed."""
    if max(np.abs(v.astype(np.float64)).max(initial=0), np.abs(centroids.astype(np.float64)).max(initial=0)) >= NARROW:
        v, centroids = v.astype(object), centroids.astype(object)
    low = bounds(small, small_centroids)
    best = low.argmin(axis=1)
    distance = exact(v, centroids[best])
    first, done = best.copy(), len(v)
    for k in range(len(centroids)):
        at = np.flatnonzero((low[:, k] <= distance) & (first != k))
        if len(at):
            found = exact(v[at], centroids[k])
            done += len(at)
            closer = (found < distance[at]) | ((found == distance[at]) & (k < best[at]))
            distance[at[closer]], best[at[closer]] = found[closer], k
    return best, distance, done


def batches_of(batches, dim: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part.column(0), whole(part.column(1), dim), whole(part.column(2), 2 * dim // SEGMENT)


def compress(dim: int):
    """mapInArrow over (vec_id, v): with the compressed form."""

    def run(batches):
        for b in batches:
            small = compressed(whole(b.column(1), dim)).ravel()
            offsets = pa.array(np.arange(0, len(small) + 1, 2 * dim // SEGMENT), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(small))], names=["vec_id", "v", "small"])

    return C.released(run)


def partial_sums(dim: int, shared):
    """mapInArrow over (vec_id, v, small): rows (cluster, part, total), the sum of each component and, at -1, the count."""

    def run(batches):
        centroids, small = shared.value
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), dim), object)
        for _, v, own in batches_of(batches, dim):
            cluster, _, _ = nearest(v, own, centroids, small)
            count += np.bincount(cluster, minlength=len(centroids))
            exact_sums = v if np.abs(v.astype(np.float64)).max(initial=0) < 1 << 50 else v.astype(object)
            for k in np.unique(cluster):
                total[k] += exact_sums[cluster == k].sum(axis=0)
        some = np.flatnonzero(count)
        numbers = np.concatenate([count[some, None].astype(object), total[some]], axis=1).ravel().tolist()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dim), len(some)), pa.int32()), pa.array(numbers, pa.decimal128(38, 0))], names=["cluster", "part", "total"])

    return C.released(run)


def assigned(dim: int, shared):
    """mapInArrow over (vec_id, v, small): rows (vec_id, cluster, distance); null distances leave the range of a long."""

    def run(batches):
        centroids, small = shared.value
        for ids, v, own in batches_of(batches, dim):
            cluster, distance, _ = nearest(v, own, centroids, small)
            if distance.dtype == object:
                distance = [x if x < 1 << 63 else None for x in distance.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return C.released(run)


def clustered(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = table.sparkSession
    vectors = integer_vectors(table, dim, scale)
    vectors = C.saved(vectors.mapInArrow(compress(dim), "vec_id long, v array<long>, small array<double>"), "vectors")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    if not first:
        C.discard(vectors)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, compressed(centroids)))
        sums = vectors.mapInArrow(partial_sums(dim, shared), "cluster int, part int, total decimal(38,0)").groupBy("cluster", "part").agg(F.sum("total").alias("total"))
        total = {(r.cluster, r.part): int(r.total) for r in sums.collect()}  # k x (dim + 1) rows
        for c in range(len(centroids)):
            if n := total.get((c, -1)):
                centroids[c] = [total[c, j] // n for j in range(dim)]
        shared.unpersist()
    shared = spark.sparkContext.broadcast((centroids, compressed(centroids)))
    out = C.saved(vectors.mapInArrow(assigned(dim, shared), "vec_id long, cluster int, distance long"), "assigned")
    C.discard(vectors)
    # k rows: sums of distances, null if a distance is
    inertia = F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("inertia")
    by_cluster = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(inertia).collect()}
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    total = None if None in by_cluster.values() else fits(sum(by_cluster.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    heads = spark.createDataFrame([(c, fits(x), total, digest[c]) for c, x in by_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(heads), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

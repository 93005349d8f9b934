"""Relationship matrices and products with them.

With w = 1 / (2 f (1 - f)) per marker and non-zero dosages only,
M K_ij = sum_m w g_i g_j - s_i - s_j + C, s_i = sum_m 2 w f g_i, C = sum_m 4 w f^2:
the exact matrix of standardised genotypes from sparse sums. Products K b never form it: per marker
u = w (g' b - 2 f sum b), then K b_i = (sum_m g_i u - sum_m 2 f u) / M, two shuffles of sparse rows for any number
of right-hand sides.
"""

from __future__ import annotations

import contextlib
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marker_weights(g: DataFrame, n_samples: int) -> DataFrame:
    """marker_id, f, w of the markers that vary."""
    x = g.groupBy("marker_id").agg((F.sum("dosage") / (2 * n_samples)).alias("f"))
    return x.where("f > 0 and f < 1").withColumn("w", 1 / (2 * F.col("f") * (1 - F.col("f"))))


def pair_kinship(g: DataFrame, weights: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(i, j, value) of K for i <= j that share a carried marker, or for given pairs of samples.

    For all pairs the self-join on markers has as many rows as there are pairs of carriers; use it on
    the few random markers of the screen, then refine the pairs that pass.
    """
    from allelia.plans.storage import saved

    x = g.join(weights, "marker_id")
    if pairs is not None:  # the calls of their samples alone; all weights are more than their files' size says
        own = pairs.select(F.explode(F.array("i", "j")).alias("sample_id")).distinct()
        x = g.join(own, "sample_id", "left_semi").join(weights.hint("merge"), "marker_id")
    x = saved(x.select("marker_id", "sample_id", "dosage", "f", "w"), "pair-calls")
    own = x.groupBy("sample_id").agg(F.sum(2 * F.col("w") * F.col("f") * F.col("dosage")).alias("s"))
    const = weights.agg(F.sum(4 * F.col("w") * F.col("f") * F.col("f")).alias("c"), F.count(F.lit(1)).alias("m"))
    a = x.select("marker_id", F.col("sample_id").alias("i"), (F.col("w") * F.col("dosage")).alias("wg"))
    b = x.select("marker_id", F.col("sample_id").alias("j"), F.col("dosage").alias("gj"))
    if pairs is None:
        cross = a.join(b, "marker_id").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("wg") * F.col("gj")).alias("dot"))
    else:
        cross = pairs.select("i", "j").join(a, "i", "left").join(b, ["j", "marker_id"], "left").groupBy("i", "j").agg(F.coalesce(F.sum(F.col("wg") * F.col("gj")), F.lit(0.0)).alias("dot"))
    si, sj = (own.select(F.col("sample_id").alias(k), F.col("s").alias(f"s{k}")) for k in "ij")
    out = cross.join(si, "i", "left").join(sj, "j", "left").crossJoin(F.broadcast(const))
    zero = F.lit(0.0)
    return out.select("i", "j", ((F.col("dot") - F.coalesce("si", zero) - F.coalesce("sj", zero) + F.col("c")) / F.col("m")).alias("value"))


def screened_pairs(g: DataFrame, weights: DataFrame, n_markers: int, cutoff: float, seed: int = 1, samples: DataFrame | None = None) -> DataFrame:
    """(i, j, value) of the pairs i < j whose kinship over a bounded number of random markers reaches the cutoff.

    Pairs without a shared carrier have (C - s_i - s_j) / M; where C / M itself reaches the cutoff, those of
    `samples` are looked at too. g and weights are scanned several times: give them saved.
    """
    from allelia.plans.storage import saved

    few = saved(weights.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("marker_id").cast("string")))).limit(n_markers), "screen")
    sharing = saved(pair_kinship(g, few).where("i < j"), "sharing")
    out = sharing.where(F.col("value") >= cutoff)
    c, m = few.agg(F.sum(4 * F.col("w") * F.col("f") * F.col("f")), F.count(F.lit(1))).first()
    if samples is None or not m or c / m < cutoff:
        return out
    own = g.join(few, "marker_id").groupBy("sample_id").agg(F.sum(2 * F.col("w") * F.col("f") * F.col("dosage")).alias("s"))
    own = samples.select("sample_id").join(own, "sample_id", "left").fillna(0.0, ["s"])
    si, sj = (own.select(F.col("sample_id").alias(k), F.col("s").alias(f"s{k}")) for k in "ij")
    apart = si.join(sj, (F.col("i") < F.col("j")) & ((c - F.col("si") - F.col("sj")) / m >= cutoff)).join(sharing, ["i", "j"], "left_anti")
    return out.union(apart.select("i", "j", ((c - F.col("si") - F.col("sj")) / m).alias("value")))


def sparse_relationship(g: DataFrame, samples: DataFrame, n_samples: int, cutoff: float = 0.125, n_markers: int = 2000) -> DataFrame:
    """Screen, refine over all markers, append the diagonal: both triangles of the sparse matrix."""
    from allelia.plans.storage import saved

    g = saved(g, "genotypes")
    w = saved(marker_weights(g, n_samples), "weights")
    screened = saved(screened_pairs(g, w, n_markers, cutoff, samples=samples), "screened")
    pairs = saved(pair_kinship(g, w, screened).where(F.col("value") >= cutoff), "pairs")
    diagonal = diagonal_kinship(g, w, samples).select(F.col("sample_id").alias("i"), F.col("sample_id").alias("j"), "value")
    return pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).union(diagonal)


def related_only(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, alone) of a sparse relationship matrix with both triangles: the entries of samples that are related to any other,
    and (sample_id, value), the diagonal of those that are not. The matrix is block-diagonal in the two."""
    related = matrix.where("i <> j").select("i").distinct()
    alone = matrix.where("i = j").join(related, "i", "left_anti").select(F.col("i").alias("sample_id"), "value")
    return matrix.join(related, "i", "left_semi").select("i", "j", "value"), alone


def diagonal_kinship(g: DataFrame, weights: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, value) of the diagonal: sum of squared standardised genotypes over M."""
    const = weights.agg(F.sum(4 * F.col("w") * F.col("f") * F.col("f")).alias("c"), F.count(F.lit(1)).alias("m"))
    d, f = F.col("dosage"), F.col("f")
    own = g.join(weights.hint("merge"), "marker_id").groupBy("sample_id").agg(F.sum(F.col("w") * (d * d - 4 * f * d)).alias("s"))
    return samples.select("sample_id").join(own, "sample_id", "left").crossJoin(F.broadcast(const)).select("sample_id", ((F.coalesce("s", F.lit(0.0)) + F.col("c")) / F.col("m")).alias("value"))


def kinship_product(g: DataFrame, weights: DataFrame, b: DataFrame, by_chrom: DataFrame | None = None) -> DataFrame:
    """K b for (sample_id, b) over all samples. With by_chrom (marker_id, chrom), also the products that
    leave one chromosome out: (full - own) / (M - M_chrom), from one pass."""
    total = b.agg(F.sum("b").alias("sum_b"))
    u = g.join(b, "sample_id").groupBy("marker_id").agg(F.sum(F.col("dosage") * F.col("b")).alias("gb"))
    u = weights.join(u, "marker_id", "left").crossJoin(F.broadcast(total))
    u = u.withColumn("u", F.col("w") * (F.coalesce("gb", F.lit(0.0)) - 2 * F.col("f") * F.col("sum_b")))
    keys = []
    if by_chrom is not None:
        u, keys = u.join(by_chrom.select("marker_id", "chrom"), "marker_id"), ["chrom"]
    const = u.groupBy(*keys).agg(F.sum(2 * F.col("f") * F.col("u")).alias("c"), F.count(F.lit(1)).alias("m"))
    part = g.join(u, "marker_id").groupBy("sample_id", *keys).agg(F.sum(F.col("dosage") * F.col("u")).alias("s"))
    if by_chrom is None:
        x = b.join(part, "sample_id", "left").crossJoin(F.broadcast(const))
        return x.select("sample_id", ((F.coalesce("s", F.lit(0.0)) - F.col("c")) / F.col("m")).alias("kb"))
    grid = b.select("sample_id").crossJoin(F.broadcast(const)).join(part, ["sample_id", "chrom"], "left")
    grid = grid.withColumn("part", F.coalesce("s", F.lit(0.0)) - F.col("c"))
    full = grid.groupBy("sample_id").agg(F.sum("part").alias("full"), F.sum("m").alias("m_full"))
    return grid.join(full, "sample_id").select("sample_id", "chrom", ((F.col("full") - F.col("part")) / (F.col("m_full") - F.col("m"))).alias("kb"))


def sparse_product(matrix: DataFrame, b: DataFrame) -> DataFrame:
    """K b for a sparse matrix of (i, j, value) with both triangles."""
    return matrix.join(b.withColumnRenamed("sample_id", "j"), "j").groupBy(F.col("i").alias("sample_id")).agg(F.sum(F.col("value") * F.col("b")).alias("kb"))


def sigma_diagonal(diagonal: DataFrame, tau: tuple[float, float], w: str = "w") -> DataFrame:
    """tau1 K_ii + tau0 / W, not below 1e-4."""
    return diagonal.withColumn("sigma", F.greatest(F.lit(1e-4), tau[1] * F.col("value") + tau[0] / F.col(w)))


def sparse_sigma(matrix: DataFrame, weights: DataFrame, tau: tuple[float, float]) -> DataFrame:
    """tau1 K with tau0 / W added on the diagonal."""
    x = matrix.join(weights.select(F.col("sample_id").alias("i"), "w"), "i")
    own = tau[1] * F.col("value")
    return x.select("i", "j", F.when(F.col("i") == F.col("j"), F.greatest(F.lit(1e-4), own + tau[0] / F.col("w"))).otherwise(own).alias("value"))


# ---------------------------------------------------------------- blocks of right-hand sides
def packed_carriers(g: DataFrame, sample_index: DataFrame, weights: DataFrame) -> DataFrame:
    """(marker_id, f, w, idx, dos, chrom): one row a marker with its carriers by sample; chrom is -1 where weights have none."""
    rows = g.join(sample_index.select("sample_id", F.col("sample_idx").cast("int").alias("sample_idx")), "sample_id")
    rows = rows.groupBy("marker_id").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "dosage"))).alias("x"))
    chrom = F.col("chrom").cast("int") if "chrom" in weights.columns else F.lit(-1)
    return rows.join(weights, "marker_id").select("marker_id", "f", "w", F.col("x.sample_idx").alias("idx"), F.col("x.dosage").alias("dos"), chrom.alias("chrom"))


def packed_placed(placed: DataFrame, n: int) -> DataFrame:
    """`packed_carriers` of calls that have their sample_idx, with weights of the markers that vary, from one grouping."""
    cell = F.struct(F.col("sample_idx").cast("int").alias("sample_idx"), "dosage")
    rows = placed.groupBy("marker_id").agg(F.sort_array(F.collect_list(cell)).alias("x"), (F.sum("dosage") / (2 * n)).alias("f"))
    rows = rows.where("f > 0 and f < 1").withColumn("w", 1 / (2 * F.col("f") * (1 - F.col("f"))))
    return rows.select("marker_id", "f", "w", F.col("x.sample_idx").alias("idx"), F.col("x.dosage").alias("dos"), F.lit(-1).alias("chrom"))


class DenseOperator:
    """K B for an N x k block B: markers stay on the executors, packed per partition as sparse columns.

    Each partition returns one N x k partial product; partials are added in a tree of sqrt(partitions)
    tasks, so the driver gets few of them. With a chromosome for each marker (a column `chrom` of weights), each
    column of the block may leave one out: `left_out` names it. That takes the same one scan.
    """

    def __init__(self, g: DataFrame, sample_index: DataFrame, n: int, weights: DataFrame, packed: DataFrame | None = None):
        from allelia.plans.storage import saved

        self.spark, self.n = g.sparkSession, n
        if packed is None:
            packed = saved(packed_carriers(g, sample_index, weights), "markers")
        self.markers = packed.select("f", "w", "idx", "dos", "chrom")
        self.sizes = {r.chrom: r["count"] for r in self.markers.groupBy("chrom").count().collect()}
        self.m = sum(self.sizes.values())
        self.fan = max(1, round(self.markers.rdd.getNumPartitions() ** 0.5))

    def __call__(self, block: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
        n, k = block.shape
        shared = self.spark.sparkContext.broadcast(block)
        fan = self.fan

        def part(batches):
            b, out = shared.value, np.zeros((n, k))
            total, const, some = b.sum(axis=0), np.zeros(k), False
            for batch in batches:
                some = True
                idx, dos = batch.column(2), batch.column(3)
                bounds = np.asarray(idx.offsets)
                flat, d = np.asarray(idx.values), np.asarray(dos.values)
                f, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                owner = np.repeat(np.arange(len(f)), np.diff(bounds))
                gb = np.column_stack([np.bincount(owner, d * b[flat, c], len(f)) for c in range(k)])
                u = w[:, None] * (gb - 2 * f[:, None] * total)
                if left_out is not None:
                    u[batch.column(4).to_numpy()[:, None] == left_out[None]] = 0
                for c in range(k):
                    np.add.at(out[:, c], flat, d * u[owner, c])
                const += (2 * f[:, None] * u).sum(axis=0)
            if some:
                import pyspark

                yield pa.RecordBatch.from_arrays([pa.array([pyspark.TaskContext.get().partitionId() % fan]), pa.array([(out - const).tobytes()])], names=["slot", "blob"])

        parts = self.markers.mapInArrow(part, "slot long, blob binary").repartition(fan, "slot").mapInArrow(_added, "blob binary")
        out = np.zeros(n * k)
        for row in parts.toLocalIterator():
            out += np.frombuffer(row.blob)
        shared.destroy()  # the driver's copy too
        return out.reshape(n, k) / _markers_of(self.sizes, left_out)

    def diagonals(self) -> dict[int, np.ndarray]:
        """Per chromosome the diagonal of the K that leaves it out, from one scan of the markers."""
        n, codes = self.n, sorted(self.sizes)
        fan = self.fan

        def part(batches):
            out = np.zeros((len(codes), n))
            for batch in batches:
                idx, dos = batch.column(2), batch.column(3)
                bounds = np.asarray(idx.offsets)
                flat, d = np.asarray(idx.values), np.asarray(dos.values)
                f, w = (np.repeat(batch.column(c).to_numpy(), np.diff(bounds)) for c in (0, 1))
                c = np.searchsorted(codes, batch.column(4).to_numpy())
                np.add.at(out, (np.repeat(c, np.diff(bounds)), flat), w * (d * d - 4 * f * d))
                f, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                out += np.bincount(c, 4 * w * f * f, len(codes))[:, None]
            import pyspark

            yield pa.RecordBatch.from_arrays([pa.array([pyspark.TaskContext.get().partitionId() % fan]), pa.array([out.tobytes()])], names=["slot", "blob"])

        total = np.zeros(len(codes) * n)
        for row in self.markers.mapInArrow(part, "slot long, blob binary").repartition(fan, "slot").mapInArrow(_added, "blob binary").toLocalIterator():
            total += np.frombuffer(row.blob)
        return _without_each(codes, total.reshape(len(codes), n), self.sizes)


def _added(batches):
    """mapInArrow over (slot, blob): the sum of each slot's blobs."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(blob)
            total[slot] = total[slot] + x if slot in total else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["blob"])


def _markers_of(sizes: dict[int, int], left_out: np.ndarray | None):
    """Markers of the K of each column."""
    m = sum(sizes.values())
    return max(m, 1) if left_out is None else np.array([max(1, m - sizes.get(int(c), 0)) for c in left_out])


def _without_each(codes, sums: np.ndarray, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    m = sum(sizes.values())
    return {c: (sums.sum(axis=0) - own) / max(1, m - sizes[c]) for c, own in zip(codes, sums)}


class LocalOperator:
    """K B with the carriers in driver memory; for few carriers, where a job per product would cost more.

    Cells are kept by marker, samples as 4 bytes and whole dosages as one; products take the cells of some markers at
    a time, so that what a product needs beside its result has a bound. The solver takes few columns in turn (`cells`).
    """

    CELLS = 1 << 16
    cells = 1 << 20

    def __init__(self, marker: np.ndarray, sample: np.ndarray, dosage: np.ndarray, f: np.ndarray, w: np.ndarray, n: int, chrom: np.ndarray | None = None):
        order = None if (np.diff(marker) >= 0).all() else np.argsort(marker, kind="stable")
        if order is not None:
            marker, sample, dosage = marker[order], sample[order], dosage[order]
        self._hold(np.searchsorted(marker, np.arange(len(f) + 1)), sample.astype(np.int32), small(dosage), f, w, n, chrom)

    @classmethod
    def of_rows(cls, start: np.ndarray, sample: np.ndarray, dosage: np.ndarray, f: np.ndarray, w: np.ndarray, n: int, chrom: np.ndarray) -> LocalOperator:
        """Of cells that lie by marker already: those of marker k are start[k] to start[k + 1]."""
        out = cls.__new__(cls)
        out._hold(start, sample, dosage, f, w, n, chrom)
        return out

    def _hold(self, start, sample, dosage, f, w, n, chrom):
        self.start, self.sample, self.dosage, self.f, self.w, self.n = start, sample, dosage, f, w, n
        self.chrom = np.full(len(f), -1) if chrom is None else chrom
        self.sizes = dict(zip(*(x.tolist() for x in np.unique(self.chrom, return_counts=True))))

    def _pieces(self):
        """(markers, samples, dosages, cells of each marker) of whole markers, about CELLS cells each."""
        lo, m = 0, len(self.f)
        while lo < m:
            hi = min(m, max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + self.CELLS, "right")) - 1))
            own = slice(self.start[lo], self.start[hi])
            yield slice(lo, hi), self.sample[own].astype(np.int64), self.dosage[own].astype(float), np.diff(self.start[lo : hi + 1])
            lo = hi

    def __call__(self, block: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
        k = block.shape[1]
        out, total = np.zeros((k, self.n)), block.sum(axis=0)
        columns = np.ascontiguousarray(block.T)
        for at, sample, dosage, size in self._pieces():
            f, w, chrom = self.f[at], self.w[at], self.chrom[at]
            some = np.flatnonzero(size)  # sums of segments take those with cells alone
            begin = (np.cumsum(size) - size)[some]
            for c in range(k):
                u = np.zeros(len(f))
                if len(some):
                    cells = columns[c][sample]
                    cells *= dosage
                    u[some] = np.add.reduceat(cells, begin)
                u = w * (u - 2 * f * total[c])
                if left_out is not None:
                    u[chrom == left_out[c]] = 0
                cells = np.repeat(u, size)
                cells *= dosage
                np.add.at(out[c], sample, cells)
                out[c] -= 2 * np.sum(f * u)
        return out.T / _markers_of(self.sizes, left_out)

    def _squares(self) -> tuple[list, np.ndarray]:
        """(codes, per chromosome the sums of squared standardised genotypes of each sample)"""
        codes = sorted(self.sizes)
        c = np.searchsorted(codes, self.chrom)
        sums = np.zeros((len(codes), self.n))
        for at, sample, d, size in self._pieces():
            owner = np.repeat(np.arange(len(size)), size)
            np.add.at(sums, (c[at][owner], sample), self.w[at][owner] * (d * d - 4 * self.f[at][owner] * d))
        return codes, sums + np.bincount(c, 4 * self.w * self.f**2, len(codes))[:, None]

    def diagonal(self) -> np.ndarray:
        return self._squares()[1].sum(axis=0) / _markers_of(self.sizes, None)

    def diagonals(self) -> dict[int, np.ndarray]:
        codes, sums = self._squares()
        return _without_each(codes, sums, self.sizes)


class _ReadCells(LocalOperator):
    """Of the rows of `_as_bytes` in a task: cells stay in memory up to HELD, beyond that in a file of the task's temporary
    folder that products read by pieces."""

    HELD = 1 << 23

    def __init__(self, batches, n: int):
        rows, self.pieces, self.file, held = [], [], None, 0
        begin = 0
        for batch in batches:
            for row in batch.to_pylist():
                f, w, chrom, size = (np.frombuffer(row[k], kind) for k, kind in (("f", float), ("w", float), ("chrom", np.int32), ("n_cells", np.int64)))
                rows.append((f, w, chrom))
                sample, dosage = np.frombuffer(row["sample"], np.int32), np.frombuffer(row["dosage"], np.int8 if row["whole"] else float)
                held += len(sample)
                if held > self.HELD:
                    self.file = self.file or tempfile.TemporaryFile()
                    place = self.file.seek(0, 2), len(sample), dosage.dtype
                    self.file.write(sample.tobytes() + dosage.tobytes())
                    sample, dosage = place, None
                start, lo = np.concatenate([[0], np.cumsum(size)]), 0
                while lo < len(f):  # pieces that a processor's cache holds
                    hi = len(f) if dosage is None else max(lo + 1, int(np.searchsorted(start, start[lo] + self.CELLS, "right")) - 1)
                    own = slice(start[lo], start[hi])
                    self.pieces.append((slice(begin + lo, begin + hi), *((sample, None) if dosage is None else (sample[own], dosage[own])), size[lo:hi]))
                    lo = hi
                begin += len(f)
        f, w, chrom = (np.concatenate(x) if rows else np.zeros(0) for x in (zip(*rows) if rows else ((),) * 3))
        self._hold(None, None, None, f, w, n, chrom)

    def _pieces(self):
        for at, sample, dosage, size in self.pieces:
            if dosage is None:
                place, count, kind = sample
                self.file.seek(place)
                sample = np.frombuffer(self.file.read(4 * count), np.int32)
                dosage = np.frombuffer(self.file.read(kind.itemsize * count), kind)
            yield at, sample.astype(np.int64), dosage.astype(float), size


def small(dosage: np.ndarray) -> np.ndarray:
    """In a byte each where that loses nothing."""
    dosage = np.asarray(dosage, float)
    if not len(dosage) or np.abs(dosage).max() > 100:
        return dosage
    out = dosage.astype(np.int8)
    return out if (out == dosage).all() else dosage


class ColumnsOperator(DenseOperator):
    """K B and what is solved with it, by columns: a task reads all cells (5 bytes each) and takes its own columns to their
    end, so that nothing of the length of the sample is exchanged between the steps of a solver."""

    def __init__(self, cells: DataFrame, n: int):
        self.spark, self.n, self.rows = cells.sparkSession, n, cells

    def mapped(self, f, payloads: list, shared=None) -> list:
        """f(operator, payload, shared) of each payload, in tasks that hold the cells; results are small or a column."""
        context = self.spark.sparkContext
        n, tasks = self.n, max(1, min(len(payloads), context.defaultParallelism))
        common, own = context.broadcast(shared), [context.broadcast(payloads[k::tasks]) for k in range(tasks)]
        dealt = None

        def task(k):
            mine = own[k]

            def run(batches):
                op = _ReadCells(batches, n)
                for at, payload in enumerate(mine.value):
                    yield pa.RecordBatch.from_arrays([pa.array([k + at * tasks]), pa.array([pickle.dumps(f(op, payload, common.value))], pa.binary())], names=["place", "found"])

            return run

        # a scan of its own for each task; a union that keeps its parts' single partition would put all in one task
        with small_batches(self.spark), setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):
            for k in range(tasks):
                part = self.rows.coalesce(1).mapInArrow(task(k), "place long, found binary")
                dealt = part if dealt is None else dealt.union(part)
            found = {r.place: pickle.loads(r.found) for r in dealt.collect()}
        for x in (common, *own):
            x.destroy()
        return [found[k] for k in range(len(payloads))]

    def columns(self, f, block: np.ndarray, shared=None, *by_column) -> np.ndarray:
        """f of each column of a block, some at a time so that the driver gets bounded results at once."""
        out, step = np.empty(block.shape), max(self.spark.sparkContext.defaultParallelism, COLUMN_CELLS // max(1, self.n))
        for lo in range(0, block.shape[1], step):
            at = range(lo, min(block.shape[1], lo + step))
            for k, x in zip(at, self.mapped(f, [(block[:, k].copy(), *(x[k] for x in by_column)) for k in at], shared)):
                out[:, k] = x
        return out

    def __call__(self, block: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
        return self.columns(_product, block) if left_out is None else self.columns(_product, block, None, left_out)

    def diagonal(self) -> np.ndarray:
        return self.mapped(_diagonal, [None])[0]

    def diagonals(self) -> dict[int, np.ndarray]:
        return self.mapped(_diagonals, [None])[0]


def _product(op, payload, shared):
    column, *left_out = payload
    return op(column[:, None], np.array(left_out) if left_out else None)[:, 0]


def _diagonal(op, payload, shared):
    return op.diagonal()


def _diagonals(op, payload, shared):
    return op.diagonals()


@contextlib.contextmanager
def setting(spark, name: str, value: str):
    """A setting of the session for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark, size: str = "4m"):
    """Arrow batches of bounded bytes for what is run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Numbers of the columns that come to the driver at once.
COLUMN_CELLS = 1 << 24

#: Carriers whose products are cheaper on the driver than a job: 5 bytes each (12 where dosages are not whole).
LOCAL_CELLS = 250_000


def kinship_operator(g: DataFrame, sample_index: DataFrame, n: int, weights: DataFrame, local_cells: int | None = None):
    """The product with K: on the driver if the checked number of carriers is small, by columns on executors otherwise."""
    return operator_of(packed_carriers(g, sample_index, weights), n, local_cells)


def operator_of(packed: DataFrame, n: int, local_cells: int | None = None):
    """`kinship_operator` of rows of `packed_carriers`."""
    from allelia.plans.storage import saved

    with small_batches(packed.sparkSession):
        packed = packed.sortWithinPartitions("marker_id")  # neighbours' carriers lie near each other
        packed = saved(packed.mapInArrow(_as_bytes, "ids binary, n_cells binary, sample binary, dosage binary, whole boolean, f binary, w binary, chrom binary"), "markers")
    if (packed.agg(F.sum(F.octet_length("sample") / 4)).first()[0] or 0) > (LOCAL_CELLS if local_cells is None else local_cells):
        return ColumnsOperator(packed, n)
    ids, count, sample, dosage, f, w, chrom = ([] for _ in range(7))
    for row in packed.collect():
        dosage.append(np.frombuffer(row.dosage, np.int8 if row.whole else float))
        for to, blob, kind in ((ids, row.ids, np.int64), (count, row.n_cells, np.int64), (sample, row.sample, np.int32), (f, row.f, float), (w, row.w, float), (chrom, row.chrom, np.int32)):
            to.append(np.frombuffer(blob, kind))
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    ids, count, f, w, chrom = (joined(x, k) for x, k in ((ids, np.int64), (count, np.int64), (f, float), (w, float), (chrom, np.int32)))
    order = np.argsort(ids, kind="stable")
    begin = np.cumsum(count) - count
    start = np.concatenate([[0], np.cumsum(count[order])])
    cells = np.repeat((begin[order] - start[:-1]).astype(np.int32), count[order])
    cells += np.arange(len(cells), dtype=np.int32)
    return LocalOperator.of_rows(start, joined(sample, np.int32)[cells], joined(dosage, np.int8)[cells], f[order], w[order], n, chrom[order])


def _as_bytes(batches):
    """mapInArrow over rows of `packed_carriers`: the columns of a batch as bytes."""
    for b in batches:
        column = dict(zip(b.schema.names, b.columns))
        dosage = small(column["dos"].flatten().to_numpy(zero_copy_only=False))
        parts = [
            column["marker_id"].to_numpy().astype(np.int64),
            np.diff(np.asarray(column["idx"].offsets)).astype(np.int64),
            column["idx"].flatten().to_numpy(zero_copy_only=False).astype(np.int32),
            dosage,
            dosage.dtype == np.int8,
            column["f"].to_numpy(),
            column["w"].to_numpy(),
            column["chrom"].to_numpy().astype(np.int32),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bool) else x.tobytes()]) for x in parts], names=["ids", "n_cells", "sample", "dosage", "whole", "f", "w", "chrom"])


class FamilySolver:
    """Exact (tau1 K + tau0 / W)^-1 B for a sparse K whose related samples form small families: one dense
    Cholesky factorisation a family, in place of iterations."""

    def __init__(self, operator: SparseOperator, largest: int = 5000):
        label = np.arange(operator.n)
        while True:  # smallest label of the family
            new = label.copy()
            np.minimum.at(new, operator.row, label[operator.col])
            new = new[new]
            if (new == label).all():
                break
            label = new
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        self.families = np.split(order, cuts)
        if max(map(len, self.families)) > largest:
            raise ValueError("a family is too large to factorise; use conjugate gradients")
        place = np.empty(operator.n, np.int64)
        for family in self.families:
            place[family] = np.arange(len(family))
        by_family = np.argsort(label[operator.row], kind="stable")
        groups = np.split(by_family, np.flatnonzero(np.diff(label[operator.row][by_family])) + 1)
        self.blocks = {}
        for cells in groups:
            if len(cells):
                family = label[operator.row[cells[0]]]
                self.blocks[family] = place[operator.row[cells]], place[operator.col[cells]], operator.value[cells]
        self.label = label

    def __call__(self, tau: tuple[float, float], w: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty_like(b)
        for family in self.families:
            m = np.diag(tau[0] / w[family])
            if (block := self.blocks.get(self.label[family[0]])) is not None:
                np.add.at(m, block[:2], tau[1] * block[2])
            out[family] = np.linalg.solve(m, b[family])
        return out


class SparseOperator:
    """K B for a sparse K held as coordinate arrays on the driver (entries grow with related pairs only)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int):
        self.row, self.col, self.value, self.n = row, col, value, n

    def __call__(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros_like(block, dtype=float)
        np.add.at(out, self.row, self.value[:, None] * block[self.col])
        return out

    def diagonal(self) -> np.ndarray:
        d = np.zeros(self.n)
        own = self.row == self.col
        d[self.row[own]] = self.value[own]
        return d

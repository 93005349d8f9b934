"""Token ids packed into fixed rows for training.

Texts are cut where white space follows something else (no token of the pattern crosses such a border),
distinct segments of a batch are tokenised once with a public byte-level BPE, and ids are put together by
gathering. Each text's ids end with the separator. Chunks of a text longer than a row are cut losslessly
at row length; chunks are packed by best-fit decreasing, where a segment tree over remaining capacities
finds the fullest row that still takes a chunk.

A task packs its rows in pools of `pool_rows` rows, so memory is bounded and nothing is shuffled. Output
is a row per packed row: ids and position_ids as little-endian uint16 matrices' rows (uint32 if the
vocabulary or the row length needs it), cu_seqlens, and per segment doc_id and the offset in its
document's ids, from which every document can be put together again.

Null and empty texts are a lone separator. Repeated rows are packed each.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXT_POINTS = 5_000_000


class Tokenizer:
    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.separator = len(table)
        self.n_bytes = np.zeros(len(table), np.int64)
        for token, i in table.items():
            self.n_bytes[i] = len(token)
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        space = [c for c in range(0x3001) if chr(c).isspace()]
        self.space = np.zeros(0x110000, bool)
        self.space[space] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the separator at its end, and their bounds."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        text_at = np.cumsum([0, *map(len, texts)])
        if not len(points):
            return np.full(len(texts), self.separator, np.int64), np.arange(len(texts) + 1)
        space = self.space[points]
        cut = np.zeros(len(points), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[text_at[:-1][text_at[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        hashes = C.span_hashes(C.mix(points.astype(np.uint64) + C.LANE[1]), starts, ends)
        _, rep, back = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends - starts
        same = (size == size[rep[back]]).all() and (points == points[np.arange(len(points)) + np.repeat(starts[rep[back]] - starts, size)]).all()
        if not same:
            rep = back = np.arange(len(starts))
        # segments that begin with white space and end without join into one call: their borders hold
        joins = space[starts[rep]] & ~space[ends[rep] - 1]
        encode = self.encoding.encode_ordinary
        made = np.array(encode("".join([whole[a:b] for a, b in zip(starts[rep[joins]].tolist(), ends[rep[joins]].tolist())])), np.int64)
        n_bytes = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)))
        reach = np.cumsum(self.n_bytes[made])
        upto = np.searchsorted(reach, np.cumsum((n_bytes[ends] - n_bytes[starts])[rep[joins]]), "left") + 1 if len(made) else np.zeros(0, np.int64)
        lone = [encode(whole[a:b]) for a, b in zip(starts[rep[~joins]].tolist(), ends[rep[~joins]].tolist())]
        rank = np.empty(len(rep), np.int64)
        rank[np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])] = np.arange(len(rep))
        own = np.concatenate([np.diff(np.append(0, upto)), np.array([len(x) for x in lone], np.int64)])
        flat = np.concatenate([made, np.array([i for x in lone for i in x], np.int64)])
        back = rank[back]
        bounds = np.append(0, np.cumsum(own))
        n_ids = own[back]
        at = np.cumsum(n_ids) - n_ids
        ids = flat[np.repeat(bounds[back] - at, n_ids) + np.arange(int(n_ids.sum()))]
        text_bounds = np.append(at, len(ids))[np.searchsorted(starts, text_at)]
        ids = np.insert(ids, text_bounds[1:], self.separator)
        return ids, text_bounds + np.arange(len(texts) + 1)


class CapacityTree:
    """Rows by remaining capacity; finds the smallest capacity of at least n that some row has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = capacity + self.size
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, row) of the tightest row with room for n, taken out."""
        k = n + self.size
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        capacity = k - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return capacity, row


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Best-fit decreasing: the chunks (each of 1 to length) of every row, in the order of placing."""
    tree, rows = CapacityTree(length), []
    for chunk in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[chunk])
        found = tree.take(n)
        if found is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(chunk)
        if capacity > n:
            tree.add(capacity - n, row)
    return rows


SCHEMA = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_offsets array<long>"


def packed_batch(ids: np.ndarray, chunk_at: np.ndarray, sizes: np.ndarray, owner: list, offset: np.ndarray, length: int, first_id: int, fill: int, wide: tuple[str, str]):
    rows = best_fit(sizes, length)
    order = np.array([c for r in rows for c in r], np.int64)
    n_chunks = np.array([len(r) for r in rows])
    row_of = np.repeat(np.arange(len(rows)), n_chunks)
    own = sizes[order]
    begin = np.cumsum(own) - own
    heads = np.append(0, np.cumsum(n_chunks))
    used = np.add.reduceat(own, heads[:-1])
    row_start = begin[heads[:-1]]
    within = np.arange(int(own.sum())) - np.repeat(begin, own)
    place = np.repeat(row_of * length + begin - row_start[row_of], own) + within
    matrix, position = np.full(len(rows) * length, fill, wide[0]), np.zeros(len(rows) * length, wide[1])
    matrix[place] = ids[np.repeat(chunk_at[order], own) + within]
    position[place] = within
    ends = begin + own - row_start[row_of]
    cu = np.insert(ends, heads[:-1], 0).astype(np.int32)
    lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
    fixed = lambda m: pa.array([x.tobytes() for x in m.reshape(len(rows), length)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first_id + np.arange(len(rows))),
            pa.array(used.astype(np.int32)),
            fixed(matrix),
            fixed(position),
            lists(heads + np.arange(len(heads)), pa.array(cu)),
            lists(heads, pa.array([owner[c] for c in order.tolist()], pa.int64())),
            lists(heads, pa.array(offset[order])),
        ],
        names=["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets"],
    ), len(rows)


_tools: dict[str, Tokenizer] = {}


def pack(docs: DataFrame, length: int = 2048, pool_rows: int = 512, ranks: str = RANKS) -> DataFrame:
    """Packed rows of all documents; see the module's text for the columns."""
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        if ranks not in _tools:
            _tools[ranks] = Tokenizer(ranks)
        tool = _tools[ranks]
        wide = ("<u2" if tool.separator < 1 << 16 else "<u4", "<u2" if length <= 1 << 16 else "<u4")
        next_id = TaskContext.get().partitionId() << 32
        ids_of, sizes_of, owners, offsets, held = [], [], [], [], 0

        def flush():
            nonlocal ids_of, sizes_of, owners, offsets, held, next_id
            if owners:
                sizes = np.concatenate(sizes_of)
                batch, n = packed_batch(np.concatenate(ids_of), np.cumsum(sizes) - sizes, sizes, owners, np.concatenate(offsets), length, next_id, tool.separator, wide)
                next_id += n
                ids_of, sizes_of, owners, offsets, held = [], [], [], [], 0
                yield batch

        for b in batches:
            doc, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, points = lo, 0
                while hi < len(texts) and (hi == lo or points + len(texts[hi]) <= TEXT_POINTS):
                    points += len(texts[hi])
                    hi += 1
                ids, bounds = tool.encode(texts[lo:hi])
                for k in range(lo, hi):
                    n = int(bounds[k - lo + 1] - bounds[k - lo])
                    parts = np.full(-(-n // length), length, np.int64)
                    parts[-1] = n - length * (len(parts) - 1)
                    ids_of.append(ids[bounds[k - lo] : bounds[k - lo + 1]])
                    sizes_of.append(parts)
                    owners += [doc[k]] * len(parts)
                    offsets.append(np.arange(len(parts)) * length)
                    held += n
                    if held >= pool_rows * length:
                        yield from flush()
                lo = hi
        yield from flush()

    return small.mapInArrow(run, SCHEMA)

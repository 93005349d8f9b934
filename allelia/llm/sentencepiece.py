"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

Per batch the distinct segments of the texts (a piece never spans two of them) are concatenated and
their suffixes sorted by their first eight bytes. Binary search gives every piece's range of suffixes
(for a longer piece, those of the range that go on like it), the ranges become edges (start, end, piece), the edges are sorted by end position, and a
relaxation over positions keeps, for each prefix, the one piece that its encoding ends with: an edge
is valid if its piece may follow the piece that the shorter prefix ends with, that is, if the merge
procedure run on both leaves the border between them. For a procedure that always merges the best
adjacent pair, all neighbours being compatible is the same as being the procedure's result, so ids
equal the library's. Characters without a piece become byte pieces.

Null text gives null ids, empty text no ids. The literal character U+2581 decodes as a space, as in
the library; all other texts come back exactly.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
UNKNOWN = -2
#: Code points of text that one suffix index takes, before the distinct segments are drawn.
BATCH_POINTS = 250_000


def _fields(data: bytes):
    """(field, value) of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        elif kind == 2:
            n, i = number(i)
            value, i = data[i : i + n], i + n
        elif kind == 5:
            (value,), i = struct.unpack_from("<f", data, i), i + 4
        else:
            (value,), i = struct.unpack_from("<d", data, i), i + 8
        yield key >> 3, value


class Vocabulary:
    """Pieces of a BPE model and what the relaxation needs to know of them."""

    def __init__(self, data: bytes):
        self.pieces, self.kinds, scores = [], [], []
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(own.get(2, 0.0))
                self.kinds.append(own.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        # priority: larger is merged earlier, equal scores from left to right
        self.priority = np.unique(np.array(scores), return_inverse=True)[1].astype(np.int32)
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == 6:
                self.byte_id[int(p[3:5], 16)] = i
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("a piece has a word mark inside it")
        splits = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    splits[a * len(self.pieces) + b] = i
        self.pair_key = np.array(sorted(splits), np.int64)
        self.pair_piece = np.array([splits[k] for k in sorted(splits)], np.int32)
        self._splits = splits
        depth = max(map(len, self.ids))
        size = len(self.pieces)
        self.merge_at = np.full((size, depth), -1, np.int32)  # priority of the n-th merge inside the piece
        self.right_at = np.zeros((size, depth), np.int32)  # its last symbol after n merges
        self.left_at = np.zeros((size, depth), np.int32)
        self.length = np.zeros(size, np.int32)
        self.depth = depth
        self.usable = []
        for p, i in self.ids.items():
            self.length[i] = len(p)
            if all(c in self.ids for c in p) and self._spines(i, [self.ids[c] for c in p]):
                self.usable.append(i)
        self.usable_pieces = [(i, self.pieces[i]) for i in self.usable]
        self.chars = np.unique(np.array([ord(c) for p in self.usable for c in self.pieces[p]], np.int64))
        self.byte_pieces = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace("▁", " ").encode() if k == 1 else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(self.pieces, self.kinds)]

    def _spines(self, piece: int, symbols: list[int]) -> bool:
        n = len(self.pieces)
        for step in range(self.depth):
            self.left_at[piece, step], self.right_at[piece, step] = symbols[0], symbols[-1]
            best, where = -1, -1
            for k in range(len(symbols) - 1):
                made = self._splits.get(symbols[k] * n + symbols[k + 1])
                if made is not None and self.priority[made] > best:
                    best, where = int(self.priority[made]), k
            if where < 0:
                return symbols == [piece]
            self.merge_at[piece, step] = best
            symbols = [*symbols[:where], self._splits[symbols[where] * n + symbols[where + 1]], *symbols[where + 2 :]]
        return False

    def slim(self) -> Vocabulary:
        del self._splits
        return self

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merge procedure on first + second leaves the border between them."""
        n = len(first)
        result = np.ones(n, bool)
        live = np.arange(n)
        i, j = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size = len(self.pieces)
        while len(live):
            a, b = first[live], second[live]
            key = self.right_at[a, i].astype(np.int64) * size + self.left_at[b, j]
            at = np.searchsorted(self.pair_key, key)
            at[at == len(self.pair_key)] = 0
            cross = np.where(self.pair_key[at] == key, self.priority[self.pair_piece[at]], -1)
            left, right = self.merge_at[a, i], self.merge_at[b, j]
            broken = (cross >= 0) & (cross > left) & (cross >= right)
            result[live[broken]] = False
            go = ~broken & ((left >= 0) | (right >= 0))
            step = left >= right
            live, i, j = live[go], (i + step)[go], (j + ~step)[go]
        return result


class Encoder:
    """Encodes batches; keeps what it has learned about pairs of pieces."""

    CACHE = 1 << 20

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.is_char = np.zeros(0x110000, bool)
        self.is_char[self.v.chars] = True
        self.cached = np.full(self.CACHE, -1, np.int64)
        self.verdict = np.zeros(self.CACHE, bool)

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        ok = before < 0  # the start of a segment or a byte piece
        at = np.flatnonzero(~ok)
        key = before[at].astype(np.int64) * len(self.v.pieces) + piece[at]
        slot = (C.mix(key.view(np.uint64)) & np.uint64(self.CACHE - 1)).astype(np.int64)
        known = self.cached[slot] == key
        ok[at[known]] = self.verdict[slot[known]]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            size = len(self.v.pieces)
            verdict = self.v.compatible(new // size, new % size)
            ok[at[~known]] = verdict[back]
            place = (C.mix(new.view(np.uint64)) & np.uint64(self.CACHE - 1)).astype(np.int64)
            # the slot's last writer wins for both arrays: write once per slot
            _, last = np.unique(place[::-1], return_index=True)
            pick = len(place) - 1 - last
            self.cached[place[pick]], self.verdict[place[pick]] = new[pick], verdict[pick]
        return ok

    def segments(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Segment starts: texts, characters without a piece, and runs of the word mark begin one."""
        known = self.is_char[points]
        cut = ~known
        cut[1:] |= ~known[:-1] | ((points[1:] == MARK) & (points[:-1] != MARK))
        cut[starts[starts < len(points)]] = True
        return np.flatnonzero(cut)

    def encode_segments(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated segments (UNKNOWN for a character without a piece) and their bounds."""
        v, n = self.v, len(points)
        ends = np.append(starts[1:], n)
        used = np.unique(points)
        used = used[self.is_char[used]]
        two = len(used) > 254
        code = np.zeros(0x110000, np.uint16)
        code[used] = np.arange(len(used)) + 1 if not two else (np.arange(len(used)) // 254 + 1) * 256 + np.arange(len(used)) % 254 + 1
        width = 2 if two else 1
        # one zero after every segment keeps matches inside it; the rest pads the last suffix
        seg_of = np.repeat(np.arange(len(starts)), ends - starts)
        flat = np.zeros(n + len(starts) + v.depth, np.uint16)
        place = np.arange(n) + seg_of
        flat[place] = code[points]
        raw = flat.astype(">u2").view(np.uint8) if two else flat.astype(np.uint8)
        depth = v.depth * width
        view = np.lib.stride_tricks.sliding_window_view(raw, depth)[:: width][place]
        view = np.ascontiguousarray(view)
        pad = -(-depth // 8) * 8
        if pad > depth:
            view = np.ascontiguousarray(np.pad(view, ((0, 0), (0, pad - depth))))
        # suffixes sorted by their first lane (what stands after a suffix's zero orders equals only)
        lanes = [np.ascontiguousarray(view[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, pad, 8)]
        order = np.argsort(lanes[0])
        lead = lanes[0][order]
        # binary search of every piece that the batch's characters can spell
        spell = {chr(c): int(code[c]).to_bytes(width, "big") for c in used.tolist()}
        names, ids = [], []
        for i, p in v.usable_pieces:
            try:
                names.append(b"".join([spell[c] for c in p]))
                ids.append(i)
            except KeyError:
                continue
        ids = np.array(ids, np.int32)
        key = np.array(names, f"S{pad}").view(np.uint8).reshape(-1, pad)
        held = np.arange(pad) < np.array([len(x) for x in names])[:, None]
        mask = np.where(held, np.uint8(255), np.uint8(0))
        lane_of = lambda x, k: np.ascontiguousarray(x[:, k : k + 8]).view(">u8").ravel().astype(np.uint64)
        low = np.searchsorted(lead, lane_of(key, 0), "left")
        high = np.searchsorted(lead, lane_of(key, 0) | ~lane_of(mask, 0), "right")
        count = high - low
        # edges; a piece longer than a lane keeps the suffixes whose other lanes begin like it
        which = np.repeat(np.arange(len(ids)), count)
        first = np.cumsum(count) - count
        begin = order[np.repeat(low - first, count) + np.arange(len(which))]
        long = np.flatnonzero(mask[which, 8]) if pad > 8 else ()
        if len(long):
            keep = np.ones(len(which), bool)
            for k in range(1, pad // 8):
                keep[long] &= lanes[k][begin[long]] & lane_of(mask, 8 * k)[which[long]] == lane_of(key, 8 * k)[which[long]]
            which, begin = which[keep], begin[keep]
        piece = ids[which]
        # sorted by the position that they end at
        step = begin - starts[seg_of[begin]] + v.length[piece]
        sort = np.argsort(step.astype(np.uint16 if len(step) and step.max() < 1 << 16 else np.int64), kind="stable")
        piece, begin, step = piece[sort], begin[sort], step[sort]
        last = np.full(n + 1, UNKNOWN, np.int32)  # by the position of the prefix's final character
        longest = int((ends - starts).max()) if n else 0
        bounds = np.searchsorted(step, np.arange(longest + 2))
        opening = np.zeros(n, bool)
        opening[starts] = True
        for s in range(1, longest + 1):
            lo, hi = bounds[s], bounds[s + 1]
            if lo == hi:
                continue
            at, p = begin[lo:hi], piece[lo:hi]
            before = np.where(opening[at], -1, last[at - 1])
            good = self.fits(before, p)
            last[at[good] + v.length[p[good]] - 1] = p[good]
        # walk back from the ends
        size = np.where(last[:n] >= 0, v.length[last[:n]], 1)
        taken = np.zeros(n, bool)
        at = ends - 1
        at = at[ends > starts]
        while len(at):
            taken[at] = True
            nxt = at - size[at]
            at = nxt[nxt >= starts[seg_of[at]]]
        ids_out = last[:n][taken]
        return ids_out, np.searchsorted(np.flatnonzero(taken), np.append(starts, n))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text."""
        marked = [("▁" + t).replace(" ", "▁") if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        text_at = np.cumsum([0, *map(len, marked)])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.segments(points, text_at[:-1])
        ends = np.append(starts[1:], len(points))
        hashes = C.span_hashes(C.mix(points.astype(np.uint64) + C.LANE[1]), starts, ends)
        _, rep, back = np.unique(hashes, return_index=True, return_inverse=True)
        # equal hashes must be equal segments
        size = ends - starts
        shift = starts[rep[back]] - starts
        if not (size == size[rep[back]]).all() or not (points == points[np.arange(len(points)) + np.repeat(shift, size)]).all():
            rep = back = np.arange(len(starts))
        own = size[rep]
        begin = np.cumsum(own) - own
        drawn = points[np.repeat(starts[rep] - begin, own) + np.arange(int(own.sum()))]
        ids, bounds = self.encode_segments(drawn, begin)
        # characters without a piece: their bytes
        lone = ids == UNKNOWN
        if lone.any():
            owner = np.repeat(np.arange(len(rep)), np.diff(bounds))
            spelled = [self.v.byte_id[list(chr(int(drawn[begin[o]])).encode("utf-8", "surrogatepass"))] for o in owner[lone]]
            grow = np.ones(len(ids), np.int64)
            grow[lone] = [len(x) for x in spelled]
            wide = np.repeat(ids, grow)
            wide[np.repeat(lone, grow)] = np.concatenate(spelled)
            bounds = np.append(0, np.cumsum(grow))[bounds]
            ids = wide
        n_ids = np.diff(bounds)[back]
        at = np.cumsum(n_ids) - n_ids
        out = ids[np.repeat(bounds[back] - at, n_ids) + np.arange(int(n_ids.sum()))]
        return out.astype(np.int32), np.append(at, len(out))[np.searchsorted(starts, text_at)]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        pieces = vocabulary.byte_pieces
        self.size = np.array([len(p) for p in pieces])
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        size = self.size[ids]
        at = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.at[ids] - at, size) + np.arange(int(size.sum()))].tobytes()
        cuts = np.append(at, len(flat))[bounds]
        return [flat[a + (b > a) : b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_ready: dict[str, tuple[Encoder, Decoder]] = {}


def worker_tools(shared) -> tuple[Encoder, Decoder]:
    key = str(shared.value[0])
    if key not in _ready:
        _ready[key] = Encoder(shared.value[1]), Decoder(shared.value[1])
    return _ready[key]


def load(spark, model: str = MODEL):
    """The model's tables as a broadcast; their size depends on the vocabulary alone."""
    with open(model, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hash(data), Vocabulary(data).slim()))


def text_groups(texts: list[str], limit: int = BATCH_POINTS):
    lo = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode_batches(shared, text: int, check: bool):
    """mapInArrow: the other columns as they are, then ids, n_tokens and, if asked for, the round trip."""

    def run(batches):
        encoder, decoder = worker_tools(shared)
        for b in batches:
            column = b.column(text)
            texts = ["" if t is None else t for t in column.to_pylist()]
            for lo, hi in text_groups(texts):
                ids, bounds = encoder.encode(texts[lo:hi])
                null = np.array(column.slice(lo, hi - lo).is_null())
                tokens = pa.ListArray.from_arrays(pa.array(np.append(bounds, 0)[: hi - lo + 1].astype(np.int32)), pa.array(ids))
                if null.any():
                    tokens = pa.array([None if n else x for n, x in zip(null, tokens.to_pylist())], pa.list_(pa.int32()))
                out = [c.slice(lo, hi - lo) for c in b.columns] + [tokens, pa.array(np.diff(bounds), pa.int64())]
                names = [*b.schema.names, "ids", "n_tokens"]
                if check:
                    back = decoder.decode(ids, bounds)
                    out.append(pa.array([x == t for x, t in zip(back, texts[lo:hi])]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def encode(docs: DataFrame, model: str = MODEL, keep_text: bool = False, check: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (decoding gives the text back); text too if asked for."""
    shared = load(docs.sparkSession, model)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = small.mapInArrow(C.released(encode_batches(shared, 1, check)), "doc_id long, text string, ids array<int>, n_tokens long" + ", round_trip boolean" * check)
    return out if keep_text else out.drop("text")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give null text."""
    shared = load(tokens.sparkSession, model)

    def run(batches):
        _, decoder = worker_tools(shared)
        for b in batches:
            lists = b.column(1).to_pylist()
            size = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            texts = decoder.decode(ids, np.append(0, np.cumsum(size)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

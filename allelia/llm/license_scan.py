"""License scans by patience alignment.

A template and a stretch of text are aligned as word sequences: words that occur once in both are
anchors, the longest increasing subsequence of anchors is kept, and the gaps between them are aligned in
the same way; a gap without anchors is aligned by its longest common subsequence. Coverage is the share of
the template's words that are aligned.

Stretches are found in one pass over all words of a text: those around the template's own key words
(fixed common words are none) with no gap of more than GAP words, cut with overlap where they are longer
than any match could be. A template matches where coverage reaches `percent` and the aligned words are
not spread over more than twice the template.

Null and empty texts match nothing; repeated rows are reported each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C
from allelia.llm.decontaminate import item_words, spaced

GAP = 12
DP_CELLS = 250_000

# Words too common to look for.
COMMON = "a all an and any are as at be by copy copies for from in is it made may not of on or other such that the these this to use version whether with without work you your".split()

# License notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second members increase, of pairs sorted by their first (patience)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[pile], piles[pile] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_subsequence(a: list[int], b: list[int], i: int, j: int) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    right = np.array(b)
    for x in range(n - 1, -1, -1):
        take = np.where(right == a[x], best[x + 1, 1:] + 1, best[x + 1, :-1])
        best[x, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    out, x, y = [], 0, 0
    while x < n and y < m and best[x, y]:
        if a[x] == b[y] and best[x, y] == best[x + 1, y + 1] + 1:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1, y] >= best[x, y + 1]:
            x += 1
        else:
            y += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) by patience alignment, in order; gaps wait on a stack."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        left, right = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {w: k for k, w in enumerate(b[j:j_end], j) if right[w] == 1}
        chain = increasing([(k, where[w]) for k, w in enumerate(a[i:i_end], i) if left[w] == 1 and w in where])
        if not chain:
            if left.keys() & right.keys():
                step = max(1, DP_CELLS // (i_end - i))
                out += common_subsequence(a[i:i_end], b[j : j + step], i, j)
            continue
        for x, y in chain:
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        out += chain
        todo.append((i, i_end, j, j_end))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], percent: int):
        common = {int(item_words(w)[0]) for w in COMMON}
        self.percent, self.items = percent, []
        owners: dict[int, list[int]] = {}
        for name, text in templates.items():
            words = item_words(text).tolist()
            keys = set(words) - common or set(words)
            self.items.append((name, words, keys))
            for w in keys:
                owners.setdefault(w, []).append(len(self.items) - 1)
        self.owners = owners
        self.keys = np.sort(np.array(list(owners), np.uint64))
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, bounds: np.ndarray):
        """(text, template, coverage, first word, end word) of every match."""
        at = np.flatnonzero(self.flags[(hashes >> np.uint64(44)).astype(np.int64)])
        near = np.searchsorted(self.keys, hashes[at])
        near[near == len(self.keys)] = 0
        at = at[self.keys[near] == hashes[at]]
        docs = np.searchsorted(bounds, at, "right") - 1
        for d in np.unique(docs).tolist():
            own = at[docs == d] if len(at) < 1000 else at[np.searchsorted(docs, d) : np.searchsorted(docs, d, "right")]
            yield from self.of_text(d, hashes, own, int(bounds[d]), int(bounds[d + 1]))

    def of_text(self, d: int, hashes: np.ndarray, own: np.ndarray, lo: int, hi: int):
        words = hashes[own].tolist()
        found = []
        for t, (_, template, keys) in enumerate(self.items):
            places = [p for p, w in zip(own.tolist(), words) if w in keys]
            todo = list(self.stretches(places, len(template), lo, hi))
            need = -(-self.percent * len(template) // 100)
            while todo:
                a, b = todo.pop()
                text = hashes[a:b].tolist()
                # words that could be aligned at all
                if b - a < need or sum((Counter(template) & Counter(text)).values()) < need:
                    continue
                pairs = self.densest(align(template, text), len(template))
                if len(pairs) >= need:
                    first, end = a + pairs[0][1], a + pairs[-1][1] + 1
                    found.append((d, t, len(pairs) / len(template), first - lo, end - lo))
                    todo += [(a, first), (end, b)]  # what stands before and after may be another
        # of matches that overlap, of one template or several, the one that explains most stays
        found.sort(key=lambda x: (-x[2], -len(self.items[x[1]][1]), x[3], x[1]))
        kept: list[tuple] = []
        ends: list[tuple[int, int]] = []
        for x in found:
            k = bisect_left(ends, (x[3], -1))
            if (k < len(ends) and ends[k][0] < x[4]) or (k and ends[k - 1][1] > x[3]):
                continue
            ends.insert(k, (x[3], x[4]))
            kept.append(x)
        yield from sorted(kept, key=lambda x: x[3])

    @staticmethod
    def stretches(places: list[int], m: int, lo: int, hi: int):
        """(start, end) of the stretches of text worth aligning."""
        k = 0
        while k < len(places):
            j = k
            while j + 1 < len(places) and places[j + 1] - places[j] <= GAP:
                j += 1
            a, b = max(lo, places[k] - m), min(hi, places[j] + m + 1)
            if b - a <= 5 * m + GAP:
                yield a, b
            else:  # windows of three templates, overlapping by two
                for s in range(a, max(a + 1, b - 2 * m), m):
                    yield s, min(b, s + 3 * m)
            k = j + 1

    @staticmethod
    def densest(pairs: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
        """The most aligned words that lie within twice the template's length."""
        best, i = [], 0
        for j in range(len(pairs)):
            while pairs[j][1] - pairs[i][1] >= 2 * m:
                i += 1
            if j - i + 1 > len(best):
                best = pairs[i : j + 1]
        return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 90) -> DataFrame:
    """A row per document and match: doc_id, license, coverage, first_word, end_word."""
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)

    def run(batches):
        scanner = Scanner(shared.value, percent)
        for b in batches:
            raw, off = C.text_buffers(b.column(1))
            ids, out = b.column(0).to_pylist(), []
            for lo, hi in C.blocks(off):
                part = spaced(raw[off[lo] : off[hi]])
                if len(part):
                    hashes, bounds = C.word_hashes(part, off[lo : hi + 1] - off[lo])
                    out += [(ids[lo + d], scanner.items[t][0], c, x, y) for d, t, c, x, y in scanner.hits(hashes, bounds)]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "license", "coverage", "first_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, end_word long")

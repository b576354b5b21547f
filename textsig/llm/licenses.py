"""License scan by patience alignment.

A text and a template, both as lower-case words, are aligned from anchors: words that occur once in either. The longest
increasing subsequence of the anchors' places is kept, equal words next to an anchor join it, and the gaps between are aligned
in the same way, until a gap has no anchors. The share of the template's words that end up aligned is its coverage.

A notice stands in one place: it is looked for in windows of the text, of up to SPREAD times as many words as the template has, so that
words strewn over a long text are none. Words that are unique in a notice may be frequent around it or in a second copy, so the
result is the best over all runs of words within a window, wherever they begin. No more words can be aligned than both have in
common, counted with repeats, and than their longest common subsequence has; texts and runs that cannot raise the best so far by these
bounds are passed over without alignment, which loses nothing.

Defined results: of equally good windows the one that is found first counts: the earliest start whose run has the longest common subsequence; a null or empty text matches nothing; templates without words match nothing; every row of the documents gives
its own result rows; null ids are carried; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

COVERAGE, SPREAD = 0.8, 2
#: Notices and the openings or full texts of widely used licenses.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. For more information, please refer to <https://unlicense.org>",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
}


def words(text: str) -> list[str]:
    """Lower-case words as `vec.runs` cuts them: ASCII letters and digits, and all beyond ASCII."""
    data, off = vec.strings(pc.utf8_lower(pa.array([text], pa.large_string())))
    start, end, _ = vec.runs(data[off[0] : off[1]], off - off[0], vec.WORD)
    raw = data[off[0] : off[1]].tobytes()
    return [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]


def _anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """(place in a, place in b) of the longest increasing run of words unique in both ranges."""
    once_b = {w: None for w, n in Counter(b[b0:b1]).items() if n == 1}
    seen: dict = {}
    for i in range(a0, a1):
        if a[i] in once_b:
            seen[a[i]] = i if a[i] not in seen else -1
    pairs = [(seen[b[j]], j) for j in range(b0, b1) if seen.get(b[j], -1) >= 0]
    # in order of b; longest increasing subsequence of the places in a
    tails, at, before = [], [], [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tails, i)
        tails[p : p + 1] = [i]
        at[p : p + 1] = [k]
        before[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        pa_, pb = a0, b0
        anchors = _anchors(a, b, a0, a1, b0, b1)
        for i, j in anchors:
            if i < pa_ or j < pb:
                continue  # an earlier anchor has taken it in
            x, y = i, j
            while x > pa_ and y > pb and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            u, v = i + 1, j + 1
            while u < a1 and v < b1 and a[u] == b[v]:
                u, v = u + 1, v + 1
            out.extend(zip(range(x, u), range(y, v)))
            todo.append((pa_, x, pb, y))
            pa_, pb = u, v
        if anchors:
            todo.append((pa_, a1, pb, b1))
    return sorted(out)


def _common(masks: list[int], n: int) -> Iterator[int]:
    """Length of the longest common subsequence with n words after each word; masks: bits of the places where the words have it."""
    full = (1 << n) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
        yield n - v.bit_count()


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.names = [n for n in sorted(templates) if words(templates[n])]
        self.words = [words(templates[n]) for n in self.names]
        column = pa.array([" ".join(w) for w in self.words] or [""], pa.large_string())
        data, off = vec.strings(column)
        start, end, count = vec.runs(data, off, vec.WORD)
        h = vec.hash_runs(data, start, end) if len(start) else np.zeros(0, np.uint64)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        self.terms = np.split(term, np.cumsum(count)[:-1])
        self.bags = np.zeros((len(self.names), len(self.vocabulary)), np.int64)
        for t in range(len(self.names)):
            np.add.at(self.bags[t], self.terms[t], 1)
        self.need = np.ceil(coverage * self.bags.sum(axis=1) - 1e-9).astype(np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def match(self, a: list[int], where: list[int], t: int) -> tuple[int, int, int] | None:
        """(aligned words, first and last word of the text in it) of template t; a: the places' terms, where: their word numbers."""
        b = self.terms[t].tolist()
        own = set(b)
        keep = [i for i, x in enumerate(a) if x in own]
        x, place = [a[i] for i in keep], [where[i] for i in keep]
        masks: dict[int, int] = {}
        for j, w in enumerate(b):
            masks[w] = masks.get(w, 0) | 1 << j
        bits = [masks[w] for w in x]
        if max(_common(bits, len(b)), default=0) < self.need[t]:
            return None
        # the words of the text from each place on that a window holds
        ends = np.searchsorted(place, np.array(place) + SPREAD * len(b)).tolist()
        best = None

        def attempt(i: int, j: int) -> None:
            nonlocal best
            got = align(x[i:j], b)
            if got and (best is None or len(got) > best[0]):
                best = (len(got), place[i + got[0][0]], place[i + got[-1][0]])

        most = lambda: max(best[0] if best else 0, int(self.need[t]) - 1)
        # for each start, the shortest run with the most in common comes first: it is a copy, or begins a little before one
        runs = []
        for i, last in enumerate(ends):
            top, end = 0, i
            if last - i >= self.need[t]:
                for j, n in enumerate(_common(bits[i:last], len(b)), i + 1):
                    if n > top:
                        top, end = n, j
            runs.append((top, end))
        bound = max(n for n, _ in runs)
        for i, (n, j) in enumerate(runs):
            if n > most():
                attempt(i, j)
        for i, (n, _) in enumerate(runs):
            if most() >= bound:
                break
            if n <= most():
                continue
            for j, n in enumerate(_common(bits[i : ends[i]], len(b)), i + 1):
                if n > most():
                    attempt(i, j)
        return best if best and best[0] >= self.need[t] else None

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, template, coverage, aligned words, first word, last word)"""
        if not self.names:
            return
        for r0, r1, data, off in vec.chunked(pc.utf8_lower(column.fill_null("").cast(pa.large_string()))):
            start, end, count = vec.runs(data, off, vec.WORD)
            if not len(start):
                continue
            h = vec.hash_runs(data, start, end)
            some = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == h[some]
            some, at = some[hit], at[hit]
            first = np.concatenate([[0], np.cumsum(count)])
            row = np.searchsorted(first, some, side="right") - 1
            key, n = np.unique(row * len(self.vocabulary) + at, return_counts=True)
            bag = np.zeros((r1 - r0, len(self.vocabulary)), np.int32)
            bag[key // len(self.vocabulary), key % len(self.vocabulary)] = n
            cut = np.searchsorted(row, np.arange(r1 - r0 + 1))
            for t in range(len(self.names)):
                own = np.flatnonzero(self.bags[t])
                common = np.minimum(bag[:, own], self.bags[t][own]).sum(axis=1)
                for r in np.flatnonzero(common >= self.need[t]):
                    i, j = cut[r], cut[r + 1]
                    got = self.match(at[i:j].tolist(), (some[i:j] - first[r]).tolist(), t)
                    if got:
                        yield r0 + int(r), t, got[0] / len(self.terms[t]), *got


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word: each template that a document's alignment covers by `coverage` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, coverage))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in vec.sliced(batches):
            found = list(s.scan(batch.column("text")))
            if found:
                row, t, share, _, a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([s.names[x] for x in t]), pa.array(np.round(share, 6)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(search, "doc_id long, license string, coverage double, first_word int, last_word int")

"""License scans by patience alignment.

A text is compared with each license template word by word: words that occur once in both
are anchors, the longest increasing subsequence of their positions is kept, and the gaps
between its members are aligned in the same way, after equal words at their ends. Coverage
is the share of the template's words that are matched; a place needs `THRESHOLD` of them.

A license can stand anywhere in a text and more than once, and then none of its words is
unique in the whole. The text is therefore aligned at every scale, tight places first: in
overlapping windows of a little more than the template's length, then of twice that, and so
on, each time in what is left between the places found, and at last as a whole, so that a
license counts however far other words spread it. A place is aligned again with the words
around it, as its window may have cut it. A window that has too few of the
template's words to reach the threshold, counted with repeats, cannot reach it by alignment
either and is passed over; the counts move along with the window.

Short phrases (titles, one-line notices, SPDX lines) say too little for that: they have to
stand there whole. Of places that overlap, the one with the most words matched, less those
of its template that are not, is kept. Words are compared in lower case without punctuation.

The long licenses are represented by the notice that their texts ask authors to attach and
by their titles; `read_templates` takes whole texts from a folder.

Defined cases: a null or empty text has no license; equal places of two licenses are decided
by name; rows are independent, so repeated rows and null ids need nothing; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

THRESHOLD = 0.8

# License texts and notices as they are published, by SPDX name.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details."
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-or-later": _GNU.format("program", ";", "General Public License", ";", "2"),
    "GPL-3.0-or-later": _GNU.format("program", ":", "General Public License", ",", "3"),
    "LGPL-2.1-or-later": _GNU.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0-or-later": _GNU.format("library", ":", "Lesser General Public License", ",", "3"),
    "AGPL-3.0-or-later": _GNU.format("program", ":", "Affero General Public License", ",", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
# Titles and one-line notices, by SPDX name.
PHRASES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License", "MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"],
    "Reserved": ["All rights reserved"],
}
# Names that SPDX lines give besides those above.
SPDX = "0BSD AFL-3.0 Artistic-2.0 BSL-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-3.0-only LGPL-2.1-only LGPL-3.0-only AGPL-3.0-only MPL-1.1 MS-PL OFL-1.1 PostgreSQL Python-2.0 WTFPL".split()


def phrases() -> dict[str, list[str]]:
    """The fixed phrases, the one-line notices of the Creative Commons licenses, and an SPDX line for each name."""
    out = {name: list(said) for name, said in PHRASES.items()}
    for name in [n for n in PHRASES if n.startswith("CC-")]:
        short = name.removeprefix("CC-").removesuffix("-4.0")
        out[name] += [f"{before}CC {short} 4.0" for before in ("Licensed under ", "")]
    for name in {*TEXTS, *PHRASES, *SPDX} - {"Reserved"}:
        out.setdefault(name, []).append(f"SPDX-License-Identifier: {name}")
    return out


def read_templates(folder: str) -> dict[str, str]:
    """Whole license texts from the files of a folder, by file name."""
    found = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as file:
            found[name] = file.read()
    return found


_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first part, whose second parts rise."""
    ends, at, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(ends, j)
        before.append(at[pile - 1] if pile else -1)
        ends[pile : pile + 1] = [j]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, in order."""
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, ii, j, jj = work.pop()
        while i < ii and j < jj and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < ii and j < jj and a[ii - 1] == b[jj - 1]:
            ii, jj = ii - 1, jj - 1
            found.append((ii, jj))
        if i == ii or j == jj:
            continue
        in_a, in_b = Counter(a[i:ii]), Counter(b[j:jj])
        place = {w: k for k, w in enumerate(b[j:jj], j) if in_b[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[i:ii], i) if w in place and in_a[w] == 1])
        if not anchors:
            continue
        found += anchors
        edges = [(i - 1, j - 1), *anchors, (ii, jj)]
        work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


class Scanner:
    """Finds templates and phrases in texts."""

    def __init__(self, templates: dict[str, str], said: dict[str, list[str]], threshold: float):
        self.templates = []
        for name, text in sorted(templates.items()):
            template = words(text)
            counts = Counter(template)
            need = max(1, -int(-threshold * len(template) // 1))
            # the words that texts lack most often come first, so that most texts are passed over at once
            self.templates.append((name, template, counts, need, sorted(counts, key=lambda w: (-len(w), w))))
        #: Phrases by their longest word: name, words, place of that word.
        self.phrases: dict[str, list[tuple[str, list[str], int]]] = {}
        for name, those in sorted(said.items()):
            for phrase in sorted({tuple(words(x)) for x in those}):
                key = max(phrase, key=len)
                self.phrases.setdefault(key, []).append((name, list(phrase), phrase.index(key)))
        self.keys = frozenset(self.phrases)

    def _may_hold(self, have: set[str], template: list[str], counts: Counter, need: int, order: list[str]) -> bool:
        spare = len(template) - need
        for w in order:
            if w not in have:
                spare -= counts[w]
                if spare < 0:
                    return False
        return True

    def _whole(self, said: list[str], template: list[str], low: int, high: int, place: tuple[int, int, int], reach: int) -> tuple[int, int, int]:
        """A place aligned again with the words around it, as long as that matches more."""
        while place[2] < len(template):
            start = max(low, place[0] - reach)
            hits = align(said[start : min(high, place[1] + 1 + reach)], template)
            if len(hits) <= place[2]:
                break
            place = (start + hits[0][0], start + hits[-1][0], len(hits))
        return place

    def places(self, said: list[str], template: list[str], counts: Counter, need: int) -> list[tuple[int, int, int]]:
        """(first word, last word, words matched) of each place of a template, tight ones first."""
        mine = [k for k, w in enumerate(said) if w in counts]
        found, segments, size = [], [(0, len(said))], len(template)
        while segments:
            left, window, stride = [], size + max(1, size // 4), max(1, size // 4)
            for low, high in segments:
                open_, start = low, low
                i = j = bisect_left(mine, low)
                have, total = Counter(), 0
                while True:
                    end = min(start + window, high)
                    while j < len(mine) and mine[j] < end:
                        w = said[mine[j]]
                        have[w] += 1
                        total += have[w] <= counts[w]
                        j += 1
                    while i < j and mine[i] < start:
                        w = said[mine[i]]
                        total -= have[w] <= counts[w]
                        have[w] -= 1
                        i += 1
                    if total >= need:
                        hits = align(said[start:end], template)
                        if len(hits) >= need:
                            first, last, n = self._whole(said, template, open_, high, (start + hits[0][0], start + hits[-1][0], len(hits)), window)
                            found.append((first, last, n))
                            left.append((open_, first))
                            open_ = start = last + 1
                            continue
                    if end == high:
                        break
                    start += stride
                if window < high - open_:
                    left.append((open_, high))
            segments = [(a, b) for a, b in left if b - a >= need and window < b - a]
            size *= 2
        return found

    def scan(self, text: str) -> list[tuple[str, str, float, int, int, int]]:
        """(name, form, coverage, words matched, first and last matched word) of each license, most telling first."""
        said = words(text)
        have, out = set(said), []
        for name, template, counts, need, order in self.templates:
            if self._may_hold(have, template, counts, need, order):
                out += [(name, "text", hits / len(template), hits, first, last, 2 * hits - len(template)) for first, last, hits in self.places(said, template, counts, need)]
        if not self.keys.isdisjoint(have):
            for k in [k for k, w in enumerate(said) if w in self.keys]:
                for name, phrase, at in self.phrases[said[k]]:
                    first = k - at
                    if first >= 0 and said[first : first + len(phrase)] == phrase:
                        out.append((name, "phrase", 1.0, len(phrase), first, first + len(phrase) - 1, len(phrase)))
        chosen, taken = [], []
        for x in sorted(out, key=lambda x: (-x[6], x[0], x[4])):
            first, last = x[4], x[5]
            at = bisect_left(taken, (first, last))
            if (at < len(taken) and taken[at][0] <= last) or (at and taken[at - 1][1] >= first):
                continue
            insort(taken, (first, last))
            chosen.append(x[:6])
        return chosen


COLUMNS = ("license", "form", "coverage", "n_matched", "first_word", "last_word")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, said: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and place: doc_id, license, form, coverage, n_matched, first_word, last_word, place (1: most telling)."""
    ship(docs.sparkSession)
    scanner = Scanner(TEXTS if templates is None else templates, phrases() if said is None else said, threshold)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(COLUMNS, x, strict=True)) for x in scanner.scan(t)] for t in texts])

    found = F.pandas_udf(run, "array<struct<license string, form string, coverage double, n_matched int, first_word int, last_word int>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found(text_of()).alias("found"))
    return rows.select("doc_id", F.posexplode("found").alias("place", "x")).select("doc_id", "x.*", (F.col("place") + 1).alias("place"))


def best(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, license (null: none), coverage, n_licenses (different ones), n_places."""
    ship(docs.sparkSession)
    scanner = Scanner(TEXTS, phrases(), THRESHOLD)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [scanner.scan(t) for t in texts]
            yield pd.DataFrame({"license": [g[0][0] if g else None for g in got], "coverage": [g[0][2] if g else 0.0 for g in got], "n_licenses": [len({x[0] for x in g}) for g in got], "n_places": [len(g) for g in got]})

    found = F.pandas_udf(run, "license string, coverage double, n_licenses long, n_places long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found(text_of()).alias("x")).select("doc_id", "x.*")

"""License scans: winnowed fingerprints, then banded alignment.

Templates are cut into words; the hashes of their k-word windows are winnowed
(the least of every few neighbours is kept) into an inverted index.  Beside
them it has single words: of a template that may lack e words, the e + 1 most
telling ones, of which every match holds one.  A document's windows and words
are looked up in it; hits on nearby diagonals form a candidate of a template
of whose words the document has enough, and a banded alignment of the template with that
part of the document reports which share of the template's words match and
which span of the text they cover.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import MAX_BROADCAST_BYTES, id_and_text, map_slices

#: Words of a fingerprint, and neighbours of which the least is kept.
WINDOW, WINNOW = 3, 2
#: Least share of a template's words that must match.
MIN_COVERAGE = 0.8
#: Words that tell little; others are preferred as single fingerprints.
_COMMON = frozenset("a above all and any are as at be by copy following for form free from hereby in into is it its may must no not of on or other part provided public purpose that the this to under use version will with without work you".split())
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software."
)
_LIABILITY = (
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."

#: (license, template): public notices, long and short.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _GRANT),
    ("MIT", _DISCLAIMER),
    ("MIT", _LIABILITY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
)


_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: (license, template): whole license texts; of the longest licenses the notice that is put into files.
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_GRANT} {_DISCLAIMER} {_LIABILITY}"),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law. " + _DISCLAIMER,
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "CC0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, "
        "to the extent allowed by law. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    ),
)


class Scanner:
    """An inverted index of winnowed template fingerprints, and the alignment."""

    def __init__(self, templates: list[tuple[str, str]], window: int = WINDOW, winnow: int = WINNOW, coverage: float = MIN_COVERAGE) -> None:
        self.names = [n for n, _ in templates]
        self.words = [_WORD.findall(t.lower()) for _, t in templates]
        if not all(self.words):
            raise ValueError("a template has no words")
        self.window, self.coverage = window, coverage
        self.vocabulary: dict[str, int] = {}
        for w in (w for t in self.words for w in t):
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.index: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            ids = [self.vocabulary[w] for w in words]
            grams = [tuple(ids[i : i + window]) for i in range(len(ids) - window + 1)]
            hashes = [zlib.crc32(repr(g).encode()) for g in grams]
            kept = {min(range(i, min(i + winnow, len(grams))), key=lambda j: (hashes[j], -j)) for i in range(max(1, len(grams) - winnow + 1)) if grams}
            for i in kept:
                self.index[grams[i]].append((k, i))
        self.firsts = {g[0] for g in self.index}
        # Of e + 1 places one is left by any e losses, wherever they are.
        self.needed = [next(x for x in range(len(t) + 1) if x >= coverage * len(t) or x / len(t) >= coverage) for t in self.words]
        self.sizes = [Counter(self.vocabulary[w] for w in t) for t in self.words]
        shared = Counter(w for t in self.words for w in set(t))
        self.telling: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            order = sorted(range(len(words)), key=lambda i: (words[i] in _COMMON, shared[words[i]], -len(words[i]), i))
            for i in order[: len(words) - self.needed[k] + 1]:
                self.telling[self.vocabulary[words[i]]].append((k, i))

    def scan(self, text: str) -> list[tuple[str, int, float, int, int]]:
        """(license, template, coverage, begin, end) of every match, in order of place."""
        low = text.lower()
        if len(low) == len(text):
            ids = list(map(self.vocabulary.get, _WORD.findall(low)))
        else:  # lower case has other places; words are lowered one by one
            low = text
            ids = [self.vocabulary.get(x.lower()) for x in _WORD.findall(text)]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        w, n = self.window, len(ids)
        known = [i for i, x in enumerate(ids) if x in self.firsts]
        for at in known:
            if at + w <= n:
                for k, i in self.index.get(tuple(ids[at : at + w]), ()):
                    hits[k].append((at - i, at))
        for at, x in enumerate(ids):
            for k, i in self.telling.get(x, ()):
                hits[k].append((at - i, at))
        if hits:
            there = set(ids)
            hits = {k: points for k, points in hits.items() if sum(n for x, n in self.sizes[k].items() if x in there) >= self.needed[k]}
        if not hits:
            return []
        places = [m.span() for m in _WORD.finditer(low)]
        found = {(self.names[k], k, share, places[a][0], places[b][1]) for k, points in hits.items() for share, a, b in self._matches(k, ids, points)}
        return self._best(sorted(found, key=lambda x: (x[3], x[4], x[1])))

    def _best(self, found: list[tuple[str, int, float, int, int]]) -> list[tuple[str, int, float, int, int]]:
        """Of templates that share a place, the ones that match it best; ``found`` is in order of place.

        A match gives way to a better one that is no shorter, and overlaps it:
        that begins after its begin less the longest match.
        """
        begins = [x[3] for x in found]
        longest = max((x[4] - x[3] for x in found), default=0)
        rank = [(x[2], len(self.words[x[1]])) for x in found]
        kept = []
        for x, own in zip(found, rank):
            near = range(bisect_right(begins, x[3] - longest), bisect_left(begins, x[4]))
            if not any(rank[j] > own and found[j][4] > x[3] and found[j][4] - found[j][3] >= x[4] - x[3] for j in near):
                kept.append(x)
        return kept

    def _matches(self, k: int, ids: list[int | None], points: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """All matches of template ``k``: hits on nearby diagonals are aligned at once, and again without the words of matches found."""
        band = max(3, len(self.words[k]) // 10)
        found: list[tuple[float, int, int]] = []
        while points:
            points.sort()
            cuts = [0, *(i for i in range(1, len(points)) if points[i][0] - points[i - 1][0] > band), len(points)]
            rest: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if hits := self._align(k, ids, points[a][0], points[b - 1][0], band):
                    found += hits
                    rest += [p for p in points[a:b] if not any(x <= p[1] <= y for _, x, y in hits)]
            if not rest:
                break
            ids = list(ids)
            for _, x, y in found:
                ids[x : y + 1] = [None] * (y + 1 - x)
            points = rest
        return found

    def _align(self, k: int, ids: list[int | None], first: int, last: int, band: int) -> list[tuple[float, int, int]]:
        """Align template ``k`` with the words on diagonals first-band..last+band: (coverage, first word, last word) of matches that share no word.

        The score is the number of equal words less a small cost for words
        skipped in the document; the band bounds both.
        """
        template = [self.vocabulary[w] for w in self.words[k]]
        low, width = first - band, last - first + 2 * band + 1
        # row: for each offset, (score, matched, first place, last place)
        none = (0.0, 0, -1, -1)
        row = [none] * width
        for i, word in enumerate(template):
            new: list[tuple[float, int, int, int]] = []
            for d in range(width):
                at = low + d + i
                best = row[d]
                if 0 <= at < len(ids) and ids[at] == word:
                    s, m, a, _ = best
                    best = (s + 1.0, m + 1, at if a < 0 else a, at)
                if d + 1 < width and row[d + 1][0] > best[0]:  # a template word the document lacks
                    best = row[d + 1]
                if d and new[d - 1][1] and new[d - 1][0] - 0.01 > best[0]:  # a document word the template lacks
                    best = (new[d - 1][0] - 0.01, *new[d - 1][1:])
                new.append(best)
            row = new
        taken: list[tuple[float, int, int]] = []
        begins: list[int] = []
        ends: list[int] = []
        for score, matched, a, b in sorted({x for x in row if x[1] and x[1] / len(template) >= self.coverage}, key=lambda x: (-x[0], x[2])):
            at = bisect_left(ends, a)
            if at == len(ends) or begins[at] > b:  # beside all those taken
                begins.insert(at, a)
                ends.insert(at, b)
                taken.append((round(matched / len(template), 4), a, b))
        return taken


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS, coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and matches.

    ``matches``: license, template (its number), coverage (share of the
    template's words found in order) and the text's span from the first to the
    last of them, in characters.  Matches of one template share no word.  Null
    or empty texts match nothing; a template without words is refused.  Null ids and repeated rows are kept, other
    columns ignored.  The index holds the templates only, and its size is
    checked.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    blob = pickle.dumps(list(templates))
    if len(blob) > MAX_BROADCAST_BYTES:
        raise ValueError(f"the templates have {len(blob)} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def each():
        scanner = Scanner(pickle.loads(shared.value), coverage=coverage)

        def step(part: pa.RecordBatch) -> dict:
            names = ("license", "template", "coverage", "begin", "end")
            return {"doc_id": part.column(0), "matches": [[dict(zip(names, m)) for m in scanner.scan(t)] for t in part.column(1).to_pylist()]}

        return step

    return map_slices(id_and_text(docs, id_col, text_col), f"doc_id {kind}, matches array<struct<license:string,template:int,coverage:double,begin:int,end:int>>", each)

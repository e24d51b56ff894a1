"""Licence scans: windows of a text against licence templates by Dice coefficient over word bigrams.

Normalised words are ``[a-z0-9]+`` after A-Z went to lower case, so line breaks and signs don't matter; a set holds distinct pairs
of neighbouring words.  As 2 * |A and B| / (|A| + |B|) can reach t only if t / (2 - t) <= |A| / |B| <= (2 - t) / t, a text
that holds fewer than t / (2 - t) of a template's bigrams is not compared with it, nor is any window outside the bounds.  Of the texts
left every window counts: one that begins or ends beside a template's bigram is never better than without it, so windows run from
one place of a template's bigram to another, and their distinct pairs are counted as the beginning moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded
from .textnum import mix, text_chunks, word_hashes

# Licences and notices as they or usual practice word them.
_NO_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission. "
)
TEMPLATES = {
    "All rights reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": _BSD_TWO + _NO_WARRANTY_BSD,
    "BSD-3-Clause": _BSD_TWO + _BSD_THIRD + _NO_WARRANTY_BSD,
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of "
        "the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of "
        "the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
        "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "GPL warranty notice": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction."
    ),
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
    ),
    "Unlicense notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}
COUNT = 256  # bigrams of a block whose marks are summed
_OTHER = np.ones(256, bool)
_OTHER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def bigrams(text: str) -> list[str]:
    """Sorted distinct bigrams of a normalised text."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the bigram that begins at each word, of the last word of a row too, first word of each row)."""
    words, first = word_hashes(data, offsets, space=_OTHER)
    return mix(words[:-1] * _FIRST + words[1:] * _SECOND), first


class Templates:
    """The templates' bigrams as sorted hashes, and which template holds which."""

    def __init__(self, texts: Mapping[str, str], threshold: float) -> None:
        self.threshold, self.least = threshold, threshold / (2 - threshold)
        sets = {}
        for name, text in texts.items():
            data = np.frombuffer(text.encode(), np.uint8)
            pairs, _ = _pairs(data, np.array([0, len(data)]))
            if len(pairs):
                sets[name] = np.unique(pairs)
        self.names = list(sets)
        self.grams = np.unique(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
        self.held = np.array([np.isin(self.grams, g) for g in sets.values()]).reshape(len(sets), len(self.grams))
        self.size = self.held.sum(1)

    def scan(self, pairs: np.ndarray, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[str, float, int, int]]:
        """(name, best Dice, first word of the best window, windows' beginnings at the threshold or above) of one text.

        pairs: its bigrams in order; at, which: the places that hold a template's bigram, and its number.
        """
        shared = self.held[:, np.unique(which)].sum(1)
        near: tuple | None = None
        for t in np.flatnonzero(shared >= self.size * self.least - 1e-9).tolist():
            own = self.held[t][which]
            near = near or _neighbours(pairs)
            found = _best_windows(len(pairs), *near, at[own], which[own], int(self.size[t]), self.least)
            hits = found >= self.threshold
            if hits.any():
                best = int(found.argmax())
                yield self.names[t], float(found[best]), int(at[own][best]), int(hits.sum())


def _neighbours(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place those of the same bigram before (-1: none) and after it (the length: none)."""
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    before, after = np.full(len(pairs), -1), np.full(len(pairs), len(pairs))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _best_windows(n: int, before: np.ndarray, after: np.ndarray, place: np.ndarray, gram: np.ndarray, size: int, least: float) -> np.ndarray:
    """The best Dice of all windows that begin at each place of a template's bigrams (0 where none is within the bounds).

    Beginnings go from the last to the first.  first marks the first occurrence of each bigram from the beginning on, so the marks up
    to an end count a window's distinct bigrams; ``nearest`` has the template's among them, whose sorted places are the ends that
    can be best.  Marks are counted by blocks, so the cost of a beginning grows with the template, not with the text.
    """
    first, blocks = np.zeros(-(-n // COUNT) * COUNT, np.uint8), np.zeros(-(-n // COUNT), np.int64)
    numbers, gram = np.unique(gram, return_inverse=True)
    nearest = np.full(len(numbers), n)
    enough, most = max(1, int(np.ceil(least * size - 1e-9))), size / least + 1e-9
    out = np.zeros(len(place))
    upto = n
    for k in range(len(place) - 1, -1, -1):
        a = int(place[k])
        fresh = np.flatnonzero(before[a:upto] < a) + a
        gone = after[a:upto]
        gone = gone[(gone >= upto) & (gone < n)]
        first[fresh] = 1
        first[gone] = 0
        np.add.at(blocks, fresh // COUNT, 1)
        np.subtract.at(blocks, gone // COUNT, 1)
        upto = a
        nearest[gram[k]] = a
        ends = np.sort(nearest)
        held = int(np.searchsorted(ends, n))
        if held < enough:
            continue
        ends = ends[enough - 1 : held]
        b = a // COUNT
        sums = np.cumsum(blocks[b : int(ends[-1]) // COUNT + 1])
        inside = np.cumsum(first.reshape(-1, COUNT)[ends // COUNT], axis=1)[np.arange(len(ends)), ends % COUNT]
        total = sums[ends // COUNT - b] - blocks[ends // COUNT] + inside
        good = total <= most
        if good.any():
            both = np.arange(enough, held + 1)[good]
            out[k] = (2.0 * both / (total[good] + size)).max()
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, dice: the best, start: the first word of the best window, n_windows) for each document and licence found.

    All windows of a text's words that begin and end with one of the template's bigrams are compared; they count, by their
    beginnings, if one reaches the threshold.  Of equally good windows the first is told.  A null or empty text and one of a single
    word match nothing; templates need two words.  Of rows with one id, repeated rows too, the windows add up; a null id is one
    document.  An empty table gives no row, other columns are not read.  Whole texts are read, a text at a time however long; only findings
    are shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            rows, found = [], []
            for row, data, offsets in text_chunks(batch, "text"):
                pairs, first = _pairs(data, offsets)
                if not len(pairs) or not len(known.grams):
                    continue
                number = np.minimum(np.searchsorted(known.grams, pairs), len(known.grams) - 1)
                hit = known.grams[number] == pairs
                inner = first[1:-1]
                hit[inner[(inner > 0) & (inner <= len(hit))] - 1] = False  # a row's last word and the next row's first
                at = np.flatnonzero(hit)
                edges = np.searchsorted(at, first)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = int(first[k]), int(first[k + 1])
                    own = at[edges[k] : edges[k + 1]]
                    for x in known.scan(pairs[a : b - 1], own - a, number[own]):
                        rows.append(row + k)
                        found.append(x)
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "license", "dice", "start", "n"])

    hits = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, license string, dice double, start long, n long")
    best = F.max(F.struct("dice", (-F.col("start")).alias("start")))
    out = hits.groupBy("id", "license").agg(best.alias("best"), F.sum("n").alias("n_windows"))
    return out.select(F.col("id").alias(id_col), "license", F.col("best.dice").alias("dice"), (-F.col("best.start")).alias("start"), "n_windows")

"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into words; of the hashes of each ``GRAM`` words, the least in every
window of ``WINDOW`` hashes is kept, and an inverted index maps it to the template and
its place. A text that shares ``GRAM + WINDOW - 1`` words in a row with a template
shares a fingerprint, so every hash of a text is looked up. Hits on near diagonals form
a candidate if enough of the template's words stand anywhere in that stretch of the text
(fewer can't be matched in order either). A banded local alignment of the two word sequences scores it: matches,
mismatches and gaps within ``BAND`` words of the diagonal (fewer for short templates). A match is reported with the
share of the template's words that it covers and its span in the text.

The templates' index is bounded by the template list and travels with each task; texts
are scanned whole, wherever they lie, so nothing is shuffled.

Defined cases: words are runs of letters and digits, compared in lower case; spans are
places in the text as it is, in code points; bytes that are not valid UTF-8 count as
replacement characters; repeated rows are searched as they come; null and
empty texts have no matches; a template below ``GRAM`` words is an error; a text with
the same license twice gives two rows; of matches that overlap, the one of the higher
alignment score stays, ties to the earlier start, then the lesser template name.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
_WORD = re.compile(r"[^\W_]+")
MATCH, MISS, GAP = 2, -2, -2
TOGETHER = 4096  # alignments in step

#: Public license notices and texts.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


class Words:
    """64-bit hashes of words, kept for words seen before."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            return np.array([known[w] for w in words], np.uint64)


def grams(h: np.ndarray) -> np.ndarray:
    """A hash of each GRAM words in a row."""
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k in range(GRAM):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def winnow(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash (the last, among equals) of every window."""
    if len(x) <= window:
        return np.flatnonzero(x == x.min())[-1:] if len(x) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(x, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(1))


class Index:
    """Template words, and sorted fingerprints with their template and place."""

    def __init__(self, templates: dict[str, str]):
        words = Words()
        self.names = sorted(templates)
        self.words = [words.hashes([w.lower() for w in _WORD.findall(templates[n])]) for n in self.names]
        if short := [n for n, w in zip(self.names, self.words, strict=True) if len(w) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words: {short}")
        rows = [(int(g[p]), t, int(p)) for t, g in enumerate(map(grams, self.words)) for p in winnow(g)]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.where = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)

    def hits(self, x: np.ndarray) -> np.ndarray:
        """(template, place in the template, place in the text) of every shared fingerprint."""
        lo = np.searchsorted(self.prints, x, "left")
        lo[lo == len(self.prints)] = 0
        at = np.flatnonzero(self.prints[lo] == x)
        hi = np.searchsorted(self.prints, x[at], "right")
        n = hi - lo[at]
        row = np.repeat(lo[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.column_stack([self.where[row], np.repeat(at, n)])


def band_of(template: np.ndarray) -> int:
    """The band's half width: BAND, or less for templates of few words, so that a second
    occurrence lies outside it."""
    return max(1, min(BAND, len(template) // 4))


def _stretches(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each diagonal the places of the text that its band covers, whether the text has
    them, and the words there."""
    place = diagonals[:, None] - band + np.arange(len(template) + 2 * band)
    within = (place >= 0) & (place < len(text))
    return place, within, text[np.where(within, place, 0)]


def _present(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, band: int) -> np.ndarray:
    """How many of the template's words stand anywhere in each diagonal's stretch of the text."""
    _, within, words = _stretches(template, text, diagonals, band)
    known, times = np.unique(template, return_counts=True)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    line, column = np.nonzero(within & (known[at] == words))
    there = np.zeros((len(diagonals), len(known)), bool)
    there[line, at[line, column]] = True
    return there @ times


def align_all(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each diagonal the best local alignment within ``band`` of ``text place - template
    place = diagonal``: score, matched words, first and last text place (end exclusive).

    All diagonals are aligned in step, a row of the template at a time. Of equal scores a
    match or mismatch is taken before a gap in the text, and that before one in the template;
    of equal ends the first.
    """
    width = 2 * band + 1
    k, lines = np.arange(width), np.arange(len(diagonals))[:, None]
    place, within, words = _stretches(template, text, diagonals, band)
    score, matches, start = (np.full((len(diagonals), width + 1), x, np.int64) for x in (0, 0, -1))
    best = np.zeros((len(diagonals), 4), np.int64)
    for i in range(len(template)):
        j, inside = place[:, i : i + width], within[:, i : i + width]
        same = inside & (words[:, i : i + width] == template[i])
        now = score[:, :-1] + np.where(same, MATCH, MISS)
        matched = matches[:, :-1] + same
        first = np.where(same & (score[:, :-1] == 0), j, start[:, :-1])
        up = score[:, 1:] + GAP
        gap = up > now
        now, matched, first = np.where(gap, up, now), np.where(gap, matches[:, 1:], matched), np.where(gap, start[:, 1:], first)
        none = ~inside | (now <= 0)
        now[none], matched[none], first[none] = 0, 0, -1
        # gaps along the row: the best earlier cell less its distance; of equal ones the nearest
        source = np.maximum.accumulate((now - GAP * k) * width + k, 1) % width
        now = now[lines, source] + GAP * (k - source)
        now[~inside] = 0
        some = now > 0
        score[:, :-1] = now
        matches[:, :-1] = np.where(some, matched[lines, source], 0)
        start[:, :-1] = np.where(some, first[lines, source], -1)
        end = now.argmax(1)
        row = np.flatnonzero(now[np.arange(len(now)), end] > best[:, 0])
        at = end[row]
        best[row] = np.column_stack([now[row, at], matches[row, at], start[row, at], j[row, at] + 1])
    return best


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """``align_all`` along one diagonal."""
    return tuple(align_all(template, text, np.array([diagonal]), band)[0].tolist())


def _apart(rows: list[tuple]) -> list[tuple]:
    """Rows in order, without those that overlap one before; (_, start, end, ...), sorted by start."""
    starts: list[int] = []
    kept: list[tuple] = []
    for r in rows:
        k = bisect.bisect_right(starts, r[1])
        if (k == 0 or kept[k - 1][2] <= r[1]) and (k == len(kept) or r[2] <= kept[k][1]):
            starts.insert(k, r[1])
            kept.insert(k, r)
    return kept


def scan(text: str, index: Index, words: Words, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, int, float]]:
    """(template, start, end, matched words, template words, coverage) in text order."""
    marks = [m.span() for m in _WORD.finditer(text)]
    if len(marks) < GRAM:
        return []
    h = words.hashes([text[a:b].lower() for a, b in marks])
    hits = index.hits(grams(h))
    if not len(hits):
        return []
    candidates: dict[int, list[int]] = {}
    order = np.lexsort((hits[:, 2] - hits[:, 1], hits[:, 0]))
    last = None
    for t, p, q in hits[order].tolist():
        d = q - p
        # hits on diagonals that one band covers and within one template's length are one candidate
        if last and last[0] == t and d - last[1] <= band_of(index.words[t]):
            continue
        last = (t, d)
        candidates.setdefault(t, []).append(d)
    rows = []
    for t, every in candidates.items():
        w = index.words[t]
        band = band_of(w)
        for at in range(0, len(every), TOGETHER):
            some = np.array(every[at : at + TOGETHER])
            some = some[_present(w, h, some, band) >= coverage * len(w)]
            found = align_all(w, h, some, band).tolist()
            rows += [(matched, a, b, index.names[t], len(w), score) for score, matched, a, b in found if score > 0 and matched >= coverage * len(w)]
    rows.sort(key=lambda r: (-r[5], r[1], r[3]))
    kept = _apart(rows)
    return [(n, marks[a][0], marks[b - 1][1], m, size, m / size) for m, a, b, n, size, _ in kept]


SCHEMA = "doc_id long, license string, start long, end long, matched_words int, template_words int, coverage double"


def find(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match."""
    store.small_batches(spark)
    held = spark.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches):
        index, words = held.value, Words()
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for m in scan(t.decode("utf-8", "replace"), index, words, coverage)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, SCHEMA)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, store.read(spark, sf_dir, "documents"))

"""Licence statements by the Dice coefficient over word bigrams.

Texts are normalised: lower-cased, words are runs of letters and digits.  The units compared are the
whole text, its paragraphs (between empty lines) and its lines; a template that none of these matches
is also sought in every window of words, across lines and paragraphs and inside them.  A unit and a template match with
2 |A and B| / (|A| + |B|) over their multisets of word bigrams; THRESHOLD or more is a find.

Size bounds: the coefficient is at most 2 min / (min + max) of the two sizes, so only templates whose
size lies between t / (2 - t) and (2 - t) / t of the unit's can match; templates are sorted by size and
a unit's candidates are one slice.  Of those, a template is compared in full only if the number of the
unit's bigrams that any template holds could reach its threshold.  A window that matches is best cut
at bigrams of the template, so windows start and end there; a start is tried only if enough of them
follow within the greatest size.

Documents are judged one by one: no shuffle, no state, memory bounded by a text.  Defined results.
Null and empty texts, and texts without a bigram, have no licence (null, coefficient 0).  Repeated
rows each get their row; ties go to the template first by name.  An empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")

_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, program: str, version: str) -> str:
    return f"{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."


#: Licence texts and the notices by which texts name a licence.
TEMPLATES = {
    "0BSD": f"{_PERMISSION}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL header": _gnu("GNU Affero General Public License", "This program", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"{_BSD} {_BSD_AS_IS}",
    "BSD-3-Clause": f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL header": _gnu("GNU Lesser General Public License", "This library", "2.1"),
    "MIT": "Released under the MIT License.",
    "MIT text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / (a.total() + b.total()) if a or b else 0.0


class Templates:
    """Templates in order of size, and the set of all their bigrams."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD) -> None:
        made = sorted((sum(grams.values()), name, grams) for name, grams in ((n, bigrams(_WORD.findall(t.lower()))) for n, t in texts.items()))
        self.rows, self.sizes, self.t = made, [n for n, *_ in made], threshold
        self.all = {g for *_, grams in made for g in grams}
        self.first = {w for w, _ in self.all}
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (_, _, grams) in enumerate(made):
            for g in grams:
                self.holders[g].append(k)

    def find(self, words: list[str]) -> tuple[float, str] | None:
        """The best template at or over the threshold for one unit."""
        n = len(words) - 1
        if n < 1:
            return None
        ratio = self.t / (2 - self.t)
        rows = self.rows[bisect_left(self.sizes, n * ratio - 1e-9) : bisect_right(self.sizes, n / ratio + 1e-9)]
        if not rows:
            return None
        shared = sum(map(self.all.__contains__, zip(words, words[1:])))
        grams, best = None, None
        for size, name, own in rows:
            if 2 * shared < self.t * (size + n) - 1e-9:
                continue
            grams = grams or bigrams(words)
            d = dice(grams, own)
            if d >= self.t and (best is None or (-d, name) < (-best[0], best[1])):
                best = d, name
        return best

    def windows(self, words: list[str], known: set[str]) -> list[tuple[int, float, str]]:
        """The best window of words of each template at or over the threshold and not known: (first word, coefficient, template)."""
        at: dict[int, list] = defaultdict(list)
        for i, g in enumerate(zip(words, words[1:])):
            if g in self.all:
                for k in self.holders[g]:
                    at[k].append((i, g))
        out = []
        for k, hits in at.items():
            size, name, own = self.rows[k]
            least, most = math.ceil(size * self.t / (2 - self.t) - 1e-9), math.floor(size * (2 - self.t) / self.t + 1e-9)
            best = (0.0, 0)
            for a in range(0 if name in known else len(hits) - least + 1):
                start = hits[a][0]
                if hits[a + least - 1][0] - start >= most:
                    continue
                left, shared = own.copy(), 0
                for b in range(a, len(hits)):
                    i, g = hits[b]
                    if i - start >= most:
                        break
                    if left[g]:
                        left[g] -= 1
                        shared += 1
                        d = 2 * shared / (size + i - start + 1)
                        if d > best[0]:
                            best = d, start
            if best[0] >= self.t:
                out.append((best[1], best[0], name))
        return out

    def scan(self, text: str) -> list[tuple[int, float, str]]:
        """Finds among the units of a text: (first line of the unit, coefficient, template), each unit once; then windows."""
        lines = [_WORD.findall(x) for x in text.lower().split("\n")]
        units: dict[tuple[int, int], None] = {(0, len(lines)): None}
        start = 0
        for i, words in enumerate([*lines, []]):
            if not words:
                if i > start:
                    units[start, i] = None
                start = i + 1
        units.update(((i, i + 1), None) for i in range(len(lines)))
        out, smallest, largest = [], self.sizes[0] * self.t / (2 - self.t), self.sizes[-1] * (2 - self.t) / self.t
        counts = [len(x) for x in lines]
        for lo, hi in units:
            if smallest - 1 <= (counts[lo] if hi == lo + 1 else sum(counts[lo:hi])) - 1 <= largest + 1:
                got = self.find(lines[lo] if hi == lo + 1 else [w for x in lines[lo:hi] for w in x])
                if got:
                    out.append((lo, *got))
        ends = list(accumulate(counts))
        found = self.windows([w for x in lines for w in x], {n for *_, n in out})
        return out + [(bisect_right(ends, i), d, n) for i, d, n in found]


def _scan(texts: dict[str, str], threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, threshold)
        for b in batches:
            found = [known.scan(t or "") for t in b.column(1).to_pylist()]
            best = [min(((-d, n) for _, d, n in f), default=(0.0, None)) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in best], pa.string()), pa.array([-d or 0.0 for d, _ in best], pa.float64()), pa.array([len({n for *_, n in f}) for f in found], pa.int64())], ["doc_id", "license", "dice", "n_licenses"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (best match, else null), dice, n_licenses (different templates found) for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, threshold), "doc_id long, license string, dice double, n_licenses long")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))

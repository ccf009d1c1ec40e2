"""License scans by patience alignment.

A text and a template are word sequences.  Words that are unique in both anchor
the alignment; the longest increasing subsequence of anchors is kept, matches
grow from each anchor while neighbouring words agree, and the gaps between are
aligned recursively.  Coverage is the share of the template's words that are
matched; a license is reported from ``threshold`` on, if the matched words make
up half of the stretch of text that they span at least.

Each text is scanned whole in its own row: no shuffle, no state.  A text is
aligned with a template only if it contains one of the template's longest
distinct words, so many that a text without any of them cannot reach the
threshold: the test loses nothing.

Defined cases: words are runs of letters, digits and inner dots, lower-cased;
null and empty texts have no license; repeated rows are scanned alike; an empty
table gives an empty result; extra columns are ignored; ties between templates
are all reported, in the templates' order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from stateloom.llm._text import small_batches

#: Well-known license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "CC-BY-NC-4.0-notice": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain "
        "View, CA 94042, USA."
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
        "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}
THRESHOLD, DENSITY = 0.8, 0.5
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (sorted by the first) with increasing seconds: patience sorting."""
    tops, piles, back = [], [], []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(n)
        else:
            tops[at], piles[at] = b, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) positions, increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, z, i, j = gaps.pop()
        if a >= z or i >= j:
            continue
        wanted = Counter(template[i:j])
        once = {w for w, c in wanted.items() if c == 1}
        seen: dict[str, int] = {}
        for p in range(a, z):
            if (w := text[p]) in once:
                seen[w] = -1 if w in seen else p
        anchors = _increasing([(seen[w], q) for w, q in sorted(((w, q) for q, w in enumerate(template[i:j], i) if seen.get(w, -1) >= 0), key=lambda x: seen[x[0]])])
        if not anchors:
            continue
        p0, q0 = a, i
        for n, (p, q) in enumerate(anchors):
            if p < p0 or q < q0:
                continue
            first_p, first_q = p, q
            while first_p > p0 and first_q > q0 and text[first_p - 1] == template[first_q - 1]:
                first_p, first_q = first_p - 1, first_q - 1
            gaps.append((p0, first_p, q0, first_q))
            end_p, end_q = (anchors[n + 1] if n + 1 < len(anchors) else (z, j))
            last_p, last_q = p + 1, q + 1
            while last_p < end_p and last_q < end_q and text[last_p] == template[last_q]:
                last_p, last_q = last_p + 1, last_q + 1
            out += zip(range(first_p, last_p), range(first_q, last_q), strict=True)
            p0, q0 = last_p, last_q
        gaps.append((p0, z, q0, j))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, density: float):
        self.threshold, self.density = threshold, density
        self.templates = [(name, words_of(text)) for name, text in templates.items()]
        self.keys = [(name, words, self._sufficient(words)) for name, words in self.templates if words]

    def _needed(self, words: list[str]) -> int:
        """The least number of matched words with enough coverage, without float error."""
        return ceil(Fraction(str(self.threshold)) * len(words))

    def _sufficient(self, words: list[str]) -> list[str]:
        """Words of which a text with enough coverage has one at least."""
        count, keys, missing = Counter(words), [], 0
        for w in sorted(count, key=lambda w: (-len(w), w)):
            if len(words) - missing < self._needed(words):
                break
            keys.append(w)
            missing += count[w]
        return keys

    def _spans(self, words: list[str], template: list[str], keys: list[str]) -> list[tuple[float, int, int]]:
        """Disjoint (coverage, first, end) stretches, best first: each key word's surroundings are aligned, closely and widely."""
        n, wide, found = len(template), int(len(template) / self.density), set()
        wanted, needed, counts = set(keys), self._needed(template), Counter(template)
        if sum((Counter(words) & counts).values()) < needed:
            return []
        for p in [p for p, w in enumerate(words) if w in wanted]:
            stretches = {(max(0, p - q), min(len(words), p - q + n)) for q, w in enumerate(template) if w == words[p]}
            for a, z in [*stretches, (max(0, p - wide), min(len(words), p + wide))]:
                # No more words can match than both have.
                matched = align(words[a:z], template) if sum((Counter(words[a:z]) & counts).values()) >= needed else []
                if matched and len(matched) >= needed:
                    first, last = a + matched[0][0], a + matched[-1][0] + 1
                    if len(matched) >= self.density * (last - first):
                        found.add((-round(len(matched) / n, 6), first, last))
        out: list[tuple[float, int, int]] = []
        for c, first, last in sorted(found):
            if all(last <= a or first >= z for _, a, z in out):
                out.append((-c, first, last))
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first and end word of the text) of each stretch found, by place."""
        low, words, out = text.lower(), None, []
        for name, template, keys in self.keys:
            if any(k in low for k in keys):
                words = words_of(text) if words is None else words
                out += [(name, *span) for span in self._spans(words, template, keys)]
        return sorted(out, key=lambda x: (x[2], x[3]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, density: float = DENSITY) -> DataFrame:
    """doc_id and found (array of license, coverage, first and end word) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    known = dict(TEMPLATES if templates is None else templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, threshold, density)
        for batch in batches:
            found = [[dict(zip(("license", "coverage", "first", "last"), x, strict=True)) for x in scanner.scan(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<license:string,coverage:double,first:int,last:int>>")

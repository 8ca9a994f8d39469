"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are its lines, the sentences of a line, its paragraphs, the whole text, and every run of consecutive
sentences across lines and paragraphs, each normalised to words of letters and digits. A unit of u bigrams can only reach a Dice coefficient of ``min_dice`` with a template of t bigrams
if ``min_dice / (2 - min_dice) * u <= t <= (2 - min_dice) / min_dice * u``, which prunes the sorted templates. The best
template of each unit is reported, unless a unit around it has a match at least as good.

Whole texts are skipped early and exactly: a match shares at least ``ceil(min_dice / (2 - min_dice) * t)`` of t bigrams,
so it holds one word of any ``t - that + 1`` bigrams of the template; such anchor words are chosen from long words. Runs of
sentences are formed only where that many bigrams of a template lie within the largest size a match can have.

Defined cases: null, empty and wordless texts have no matches; a text with one word has no bigram; rows that repeat
are scanned each; a null doc_id is kept; an empty table gives no rows; extra columns are ignored. Of equally good
templates the first in name order is reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import small_batches, text_bytes

MIN_DICE = 0.8

# Texts and customary notices of public licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 (long notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has waived all copyright and related or "
                        "neighboring rights to this work.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "MIT (notice)": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0 (notice)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense (notice)": "This is free and unencumbered software released into the public domain.",
}

# A-Z to a-z; letters, digits, bytes of other scripts and newlines stay; all else becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 or c == 10 else 32
               for c in range(256))
_SENTENCE = re.compile(rb"(?<=[.!?])[ \t]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 |a & b| / (|a| + |b|) over multisets."""
    total = a.total() + b.total()
    if len(a) > len(b):
        a, b = b, a
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / total if total else 0.0


def _sentences(text: bytes) -> list[tuple[int, int, int, int]]:
    """First and last byte, first and last word of each sentence of a line that has words."""
    out, at, word = [], 0, 0
    for line in text.split(b"\n"):
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
        for a, b in zip(cuts, cuts[1:]):
            n = len(words_of(line[a:b]))
            if n:
                out.append((at + a, at + b, word, word + n))
                word += n
        at += len(line) + 1
    return out


@dataclass(frozen=True)
class Match:
    license: str
    dice: float
    start: int
    end: int


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE):
        if not 0 < min_dice <= 1:
            raise ValueError("min_dice must be above 0 and at most 1")
        self.min_dice = min_dice
        grams = {name: bigrams(words_of(t.encode())) for name, t in (templates or TEMPLATES).items()}
        self.templates = sorted(((g.total(), name, g) for name, g in grams.items() if g), key=lambda x: x[:2])
        self.sizes = [t[0] for t in self.templates]
        self.ratio = min_dice / (2 - min_dice)
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (_, _, g) in enumerate(self.templates):
            for pair in g:
                self.holders.setdefault(pair, []).append(i)
        self.anchors: set[bytes] = set()
        for total, _, g in self.templates:
            needed = total - ceil(self.ratio * total - 1e-9) + 1
            by_word = sorted(g.elements(), key=lambda p: (-max(map(len, p)), p))[:needed]
            self.anchors |= {max(p, key=lambda w: (len(w), w)) for p in by_word}

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """The best template of a unit, if it reaches the threshold."""
        u = len(words) - 1
        if u < 1 or self.anchors.isdisjoint(words):
            return None
        lo = bisect_left(self.sizes, self.ratio * u - 1e-9)
        hi = bisect_right(self.sizes, u / self.ratio + 1e-9)
        if lo >= hi:
            return None
        grams = bigrams(words)
        found = min(((-dice(grams, g), name) for _, name, g in self.templates[lo:hi]), default=None)
        return (-found[0], found[1]) if found and -found[0] >= self.min_dice else None

    def runs(self, text: bytes, words: list[bytes]) -> Iterator[Match]:
        """Every run of consecutive sentences that reaches the threshold with a template."""
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for t in self.holders.get(pair, ()):
                places.setdefault(t, []).append(i)
        pieces: list[tuple[int, int, int, int]] = []        # bytes and words of each sentence with words
        for t, at in places.items():
            total, name, grams = self.templates[t]
            needed, most = ceil(self.ratio * total - 1e-9), int(total / self.ratio + 1e-9)
            if not any(b - a < most for a, b in zip(at, at[needed - 1:])):
                continue
            pieces = pieces or _sentences(text)
            for i, (start, _, first, _) in enumerate(pieces):
                low = bisect_left(at, first)
                if low + needed > len(at) or at[low + needed - 1] - first >= most:
                    continue
                seen: Counter = Counter()
                shared, done = 0, first
                for j in range(i, len(pieces)):
                    _, end, _, last = pieces[j]
                    u = last - first - 1
                    if u > most:
                        break
                    for pair in zip(words[done:last - 1], words[done + 1:last]):
                        if pair in grams:
                            seen[pair] += 1
                            shared += seen[pair] <= grams[pair]
                    done = last - 1
                    value = 2 * shared / (u + total)
                    if value >= self.min_dice:
                        yield Match(name, value, start, end)

    def scan(self, text: bytes | None) -> list[Match]:
        """Matches with byte offsets, in order of their place."""
        if not text:
            return []
        words = words_of(text)
        if self.anchors.isdisjoint(words):
            return []
        units: set[tuple[int, int]] = {(0, len(text))}
        at, paragraph = 0, None
        for line in [*text.split(b"\n"), b""]:
            end = at + len(line)
            if line.strip():
                units.add((at, end))
                paragraph = (at if paragraph is None else paragraph[0], end)
                if not self.anchors.isdisjoint(words_of(line)):
                    cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
                    units |= {(at + a, at + b) for a, b in zip(cuts, cuts[1:]) if b > a}
            elif paragraph:
                units.add(paragraph)
                paragraph = None
            at = end + 1
        found = []
        for a, b in units:
            hit = self.best(words_of(text[a:b]))
            if hit:
                found.append(Match(hit[1], hit[0], a, b))
        found += self.runs(text, words)
        found.sort(key=lambda m: (-m.dice, m.start - m.end, m.start, m.license))
        out: list[Match] = []                   # kept matches in order of their place; none overlap
        for m in found:                         # the better unit wins where units overlap
            at = bisect_left(out, m.end, key=lambda o: o.start)
            if not at or out[at - 1].end <= m.start:
                out.insert(at, m)
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """``doc_id, license, dice, start_byte, end_byte``: one row per match in a whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_dice)
        for batch in batches:
            hits = [(i, m) for i, t in enumerate(text_bytes(batch.column(1))) for m in scanner.scan(t)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([i for i, _ in hits], pa.int64())),
                pa.array([m.license for _, m in hits], pa.string()), pa.array([m.dice for _, m in hits], pa.float64()),
                pa.array([m.start for _, m in hits], pa.int64()), pa.array([m.end for _, m in hits], pa.int64()),
            ], ["doc_id", "license", "dice", "start_byte", "end_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, license string, dice double, start_byte long, end_byte long")

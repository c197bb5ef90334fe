"""License scan: named phrases, and an exact set-similarity join of text blocks with license notices.

A template is a license notice as a set of t words; n words long, it is looked for in blocks of n / threshold
consecutive words of a text, wherever lines break and whatever marks stand before them. A block matches if it
holds at least `threshold` of the template's words. Words are ordered by the number of texts that have them,
the rarest first. The join looks only at blocks around a word of a template's prefix: a template that needs
an overlap of o shares one of its first t - o + 1 words with each matching block. The length filter drops
texts with fewer than o of its words, the positional filter the places around a prefix word where fewer than
o of them stand close enough. What is left is counted exactly, block by block.

One pass reads the texts and writes, for each row, the phrase places and the template words with their places
(none where no template has enough of its words in the text), and for each task how many texts have each
template word. The join takes that table. The templates are a parameter, so the word list and what each task
is given are bounded by what the caller wrote. Nothing is shuffled but the counts.

Null texts count as empty: no words, no labels, score 0. Repeated rows are reported each. An empty table
gives an empty result. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, small_batches

#: Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: License notices and single sentences that grant a license, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", _BSD + _BSD_DISCLAIMER),
    ("bsd", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
THRESHOLD = 0.9
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case: what stands between other ASCII characters than letters
    and digits."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def block_words(length: int, threshold: float) -> int:
    """The words of a block for a template of this length."""
    return math.ceil(length / threshold - 1e-9)


@dataclass
class Template:
    label: str
    words: frozenset[int]  # numbers in the vocabulary
    need: int
    block: int
    prefix: frozenset[int] = frozenset()

    def overlap(self, places: list[int], words: list[int]) -> int:
        """The most words of the template in one block, 0 below the need."""
        own = [(at, w) for at, w in zip(places, words) if w in self.words]
        if len(own) < self.need:  # length filter
            return 0
        best = lo = 0
        while lo < len(own):
            # a stretch of places within a block of each other's prefix words
            while lo < len(own) and own[lo][1] not in self.prefix:
                lo += 1
            if lo == len(own):
                break
            first, reach, hi = own[lo][0] - self.block + 1, own[lo][0] + self.block - 1, lo
            while hi < len(own) and own[hi][0] <= reach:
                if own[hi][1] in self.prefix:
                    reach = own[hi][0] + self.block - 1
                hi += 1
            start = lo
            while start > 0 and own[start - 1][0] >= first:
                start -= 1
            if hi - start >= self.need:  # positional filter
                best = max(best, self.slide(own[start:hi]))
            lo = hi
        return best if best >= self.need else 0

    def slide(self, own: list[tuple[int, int]]) -> int:
        held: Counter[int] = Counter()
        best = tail = 0
        for at, w in own:
            held[w] += 1
            while own[tail][0] <= at - self.block:
                held[own[tail][1]] -= 1
                if not held[own[tail][1]]:
                    del held[own[tail][1]]
                tail += 1
            best = max(best, len(held))
        return best


def phrase_places(words: list[bytes], low: bytes, phrase: list[bytes]) -> list[int]:
    """Where the phrase starts, as word numbers from 0."""
    out: list[int] = []
    if not all(p in low for p in phrase):
        return out
    at = -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def templates_of(templates: list[tuple[str, str]], threshold: float) -> tuple[dict[bytes, int], list[Template]]:
    listed = [(label, words_of(text)) for label, text in templates]
    numbers = {w: i for i, w in enumerate(sorted({w for _, words in listed for w in words}))}
    out = [Template(label, frozenset(numbers[w] for w in words), needed(len(set(words)), threshold), block_words(len(words), threshold)) for label, words in listed if words]
    return numbers, out


READ = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, places array<int>, words array<int>, counts boolean"


def read_texts(docs: DataFrame, phrases: dict[str, str], numbers: dict[bytes, int], templates: list[Template]) -> DataFrame:
    """One row for each row of docs, and one for each task (`counts`) with the numbers of texts by word."""
    named = [(label, [w.encode() for w in phrase.split()]) for phrase, label in phrases.items()]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
    columns = [x.split()[0] for x in READ.split(", ")]
    vocabulary = frozenset(numbers)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                low = text.encode("utf-8", "surrogatepass").lower()
                words = WORD.findall(low)
                places, base = [], []
                for label, phrase in named:
                    found = phrase_places(words, low, phrase)
                    places += found
                    if found and label not in base:
                        base.append(label)
                have = {numbers[w] for w in vocabulary.intersection(words)}
                seen.update(have)
                wanted = frozenset().union(*(t.words for t in templates if len(t.words & have) >= t.need))
                spots = [(i, n) for i, w in enumerate(words) if (n := numbers.get(w, -1)) in wanted] if wanted else []
                out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), [i for i, _ in spots], [n for _, n in spots], False))
            yield table_of(out)
        yield table_of([(None, 0, 0, None, None, [], list(seen), list(seen.values()), True)])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        return cut(rows.mapInArrow(read, READ), "licenses")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    numbers, listed = templates_of(templates, threshold)
    rows = read_texts(docs, phrases, numbers, listed)
    each = rows.where("counts").select(F.explode(F.arrays_zip("places", "words")).alias("x")).groupBy(F.col("x.places").alias("word"))
    texts = {r.word: r.n for r in each.agg(F.sum("x.words").alias("n")).collect()}  # a row for each template word at most
    for t in listed:
        ordered = sorted(t.words, key=lambda w: (texts.get(w, 0), w))
        t.prefix = frozenset(ordered[: len(ordered) - t.need + 1])

    kept = ["doc_id", "n_words", "n_base", "first_word", "last_word"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, labels, scores = [], [], []
            for base, places, words in zip(*(batch.column(c).to_pylist() for c in ("base", "places", "words"))):
                found = [(t.label, t.overlap(places, words) / len(t.words)) for t in listed] if places else []
                names.append(",".join(base))
                labels.append(",".join(sorted({*base, *(label for label, s in found if s)})))
                scores.append(max((s for _, s in found), default=0.0))
            out = [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, [*kept, "base_labels", "labels", "score"])

    schema = ", ".join(f"{c} long" for c in kept) + ", base_labels string, labels string, score double"
    return rows.where("not counts").mapInArrow(joined, schema)

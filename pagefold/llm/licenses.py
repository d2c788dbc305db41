"""Licence scans: base phrases, and licence texts found through a positional index of rare words.

Every word of every template is in the index with its positions. Over the whole corpus the words' document frequencies are
counted. A file's licence words are looked up from the highest IDF down: a word's postings count for each template whose key
words the file has, until ANCHORS of the template's words are looked up. A posting says where its template would begin; where two
words agree on that, give or take the template's slack, its words are compared with the file's there: the mandatory key phrases
have to stand in them, and the share of its words that match in order is the score. All texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import small_batches

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Wording that several licences share.
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_END = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
# Label, wording, mandatory key phrases. Whole licences, the headers that files carry, and one-line notices.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", f"{_PERMISSION}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} {_MIT_END}", ("permission is hereby granted free of charge", "this permission notice shall be included in all copies", "provided as is without warranty of any kind")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2 0", "you may not use this file except in compliance with the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3 of the license")),
    ("gpl-3.0", _GNU.format(kind="General", n=3), ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2 of the license")),
    ("gpl-2.0", _GNU.format(kind="General", n=2), ("gnu general public license", "version 2 of the license")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}", ("redistributions in binary form must reproduce the above copyright notice", "even if advised of the possibility of such damage")),
    ("bsd-3-clause", f"{_BSD} {_BSD_3} {_BSD_END}", ("redistributions in binary form must reproduce the above copyright notice", "neither the name of", "to endorse or promote products derived from this software")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("for any purpose with or without fee is hereby granted", "the author disclaims all warranties with regard to this software")),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("the origin of this software must not be misrepresented",)),
    ("bsl-1.0", "Boost Software License - Version 1.0 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", ("boost software license version 1 0",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.", ("do what the fuck you want to public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
)
#: A label is left out where one that says more is found.
SAYS_LESS = {"bsd": ("bsd-2-clause", "bsd-3-clause"), "bsd-2-clause": ("bsd-3-clause",)}
#: Words looked up for a template; words by which starts may differ (a template of LOOSE words more has one more); least score.
ANCHORS, SLACK, LOOSE, LEAST_SCORE = 4, 3, 12, 0.7

_SPLIT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z in lower case; digits, letters and all beyond ASCII."""
    return text.translate(_SPLIT).split()


def _split(phrase: str) -> list[bytes]:
    return words(phrase.encode())


@dataclass(frozen=True)
class Template:
    label: str
    words: list[bytes]
    keys: tuple[list[bytes], ...]

    @cached_property
    def distinct(self) -> frozenset[bytes]:
        return frozenset(self.words)

    @cached_property
    def needed(self) -> frozenset[bytes]:
        """The key phrases' words; a file without one of them can't have the template."""
        return frozenset(w for k in self.keys for w in k)

    @cached_property
    def slack(self) -> int:
        return SLACK + len(self.words) // LOOSE


NOTICES = tuple(Template(label, _split(text), tuple(map(_split, keys))) for label, text, keys in TEMPLATES)
VOCABULARY = frozenset(w for t in NOTICES for w in t.words)


def places(where: list[bytes], phrase: list[bytes], start: int = 0, stop: int | None = None) -> list[int]:
    """Starts of phrase in where[start:stop]."""
    out, at, stop = [], start - 1, len(where) if stop is None else stop
    while True:
        try:
            at = where.index(phrase[0], at + 1, stop)
        except ValueError:
            return out
        if where[at : at + len(phrase)] == phrase and at + len(phrase) <= stop:
            out.append(at)


@dataclass
class Index:
    """rank: word -> its place from the highest IDF down; postings: word -> (template, position)."""

    rank: dict[bytes, int]
    postings: dict[bytes, list[tuple[int, int]]]

    def match(self, ws: list[bytes], present: set[bytes]) -> dict[str, float]:
        """Labels of the templates that stand in the words, with their best scores; present: the licence words among them."""
        open_ = {t: 0 for t, x in enumerate(NOTICES) if x.needed <= present}  # templates, and how many of their words are looked up
        if not open_:
            return {}
        begins: dict[int, list[tuple[int, bytes]]] = {t: [] for t in open_}
        for w in sorted(present, key=self.rank.__getitem__):
            mine = [(t, k) for t, k in self.postings[w] if open_.get(t, ANCHORS) < ANCHORS]
            if mine:
                at = places(ws, [w])
                for t, k in mine:
                    begins[t] += [(x - k, w) for x in at]
                for t in {t for t, _ in mine}:
                    open_[t] += 1
        best: dict[str, float] = {}
        for t, found in begins.items():
            x = NOTICES[t]
            for at in agreed(sorted(found), x.slack, min(2, open_[t])):
                score = verified(ws, at, x)
                if score >= LEAST_SCORE:
                    best[x.label] = max(score, best.get(x.label, 0.0))
        return {label: score for label, score in best.items() if not any(more in best for more in SAYS_LESS.get(label, ()))}


def agreed(found: list[tuple[int, bytes]], slack: int, need: int) -> Iterator[int]:
    """Starts, from sorted (start, word), about which need words agree within slack. The comparison at a start covers those up to twice the slack after it, so these are passed over."""
    a, seen, done = 0, Counter(), -(1 << 60)
    for at, w in found:
        seen[w] += 1
        while found[a][0] < at - slack:
            seen[found[a][1]] -= 1
            if not seen[found[a][1]]:
                del seen[found[a][1]]
            a += 1
        if len(seen) >= need and at > done + slack:
            done = at
            yield found[a][0]


def verified(ws: list[bytes], at: int, template: Template) -> float:
    """Share of the template's words that match in order about place at; 0 if a key phrase isn't there."""
    wanted, slack = template.words, template.slack
    low, high = max(0, at - slack), min(len(ws), max(0, at) + len(wanted) + 2 * slack)
    if not all(places(ws, k, low, high) for k in template.keys):
        return 0.0
    if at >= 0 and ws[at : at + len(wanted)] == wanted:
        return 1.0
    return sum(b.size for b in SequenceMatcher(None, wanted, ws[low:high], autojunk=False).get_matching_blocks()) / len(wanted)


def build(frequency: dict[bytes, int], documents: int) -> Index:
    """The index of all templates' words, ranked by the IDF of a corpus of so many documents."""
    idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in VOCABULARY}
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for t, x in enumerate(NOTICES):
        for k, w in enumerate(x.words):
            postings.setdefault(w, []).append((t, k))
    return Index({w: k for k, w in enumerate(sorted(VOCABULARY, key=lambda w: (-idf[w], w)))}, postings)


def _texts(col: pa.Array) -> list[bytes]:
    return col.cast(pa.binary()).to_pylist()


def index(docs: DataFrame) -> Index:
    """The index for a corpus: one row for each of the templates' words and task is summed, over all documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = Counter(), 0
        for b in batches:
            for text in _texts(b.column(0)):
                n += 1
                total.update(VOCABULARY.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in total)], "n": [n, *total.values()]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return build(found, found.get(b"", 0))


FOUND = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double>"


def scan(text: bytes, by: Index) -> dict:
    ws = words(text)
    present = VOCABULARY.intersection(ws)
    starts: list[int] = []
    base: set[str] = set()
    if b"license" in text.lower():
        for phrase, label in BASE:
            if at := places(ws, _split(phrase)):
                base.add(label)
                starts += at
    more = by.match(ws, present) if present else {}
    return {"n_words": len(ws), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | set(more))), "score": max(more.values(), default=0.0)}


def found_column(docs: DataFrame) -> Column:
    """A column with what scan() finds in docs.text (null: empty); the index is that of docs."""
    by = index(docs)
    shared = docs.sparkSession.sparkContext.broadcast(by)
    fields = [x.split(":") for x in FOUND[7:-1].split(", ")]
    kind = pa.struct([(n, {" bigint": pa.int64(), " string": pa.string(), " double": pa.float64()}[t]) for n, t in fields])

    @F.arrow_udf(FOUND)
    def found(col: pa.Array) -> pa.Array:
        return pa.array([scan(t, shared.value) for t in _texts(col)], kind)

    return found(F.coalesce("text", F.lit("")))


def license_rows(docs: DataFrame) -> DataFrame:
    """doc_id and what scan() finds, for every row of docs (doc_id, text; others are left out). Repeated rows and null ids stay."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", found_column(docs).alias("found")).select("doc_id", "found.*")

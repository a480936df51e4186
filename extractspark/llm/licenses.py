"""Licence notices by a positional index of rare words.

Words are runs of ASCII letters and digits and of everything beyond ASCII, lower-cased A-Z. The index posts every word of
every template with its positions. Document frequencies of these words come from one pass over all documents.

A file is searched by its licence words of the highest inverse document frequency: those that are anchors, the rarest
words of some template, as many as every notice that reaches the share must hold one of. An anchor's posting proposes the
place of a template; there the postings of all its words are intersected with the file's words by relative position: a
word counts if it stands within ``slack`` places of where the template has it, and the counted words must stand in the
template's order. So inserted, lost and changed words cost their own weight only. A template is found where the counted
words' weight reaches the share and all its mandatory key phrases stand. Three base phrases are located wherever their
words stand consecutively.

The score is the highest share of a found template; base phrases are no part of it.

Defined results: a null or empty text has no words, no places and no labels, score 0; a text of any length is scanned
whole, in one task; of places that reach the same share the first counts, and words of equal frequency are ranked by
their bytes; repeated rows are scanned each for itself; a null doc_id stays null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, lean, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wording of public licences and of common notices, with the phrases that must stand in it.
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
TEMPLATES = [
    ("agpl-3.0", GNU.format("Affero General Public License", "3"), ["affero general public license"]),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License version 3", ["affero general public license"]),
    ("apache-2.0", APACHE, ["apache license version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("bsd-2-clause", f"{BSD_START}\n{BSD_END}", ["source and binary forms", "redistributions in binary form"]),
    ("bsd-3-clause", f"{BSD_START}\n{BSD_NAMES}\n{BSD_END}", ["source and binary forms", "endorse or promote"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["source and binary forms"]),
    ("bsl-1.0", BOOST, ["person or organization obtaining a copy"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike 4 0"]),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0", ["cc0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0", ["waived all copyright"]),
    ("gpl-2.0", GNU.format("General Public License", "2"), ["version 2 of the license"]),
    ("gpl-2.0", "Licensed under the GNU General Public License version 2", ["general public license version 2"]),
    ("gpl-3.0", GNU.format("General Public License", "3"), ["version 3 of the license", "gnu general public license"]),
    ("gpl-3.0", "Licensed under the GNU General Public License version 3", ["general public license version 3"]),
    ("isc", ISC, ["permission to use copy modify"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", ["permission to use copy modify"]),
    ("lgpl-3.0", GNU.format("Lesser General Public License", "3"), ["lesser general public license"]),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License version 3", ["lesser general public license"]),
    ("mit", MIT, ["permission is hereby granted free of charge", "the software is provided as is"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", ["permission is hereby granted"]),
    ("mit", "Released under the MIT license", ["mit license"]),
    ("mpl-2.0", MPL, ["mozilla public license v 2 0"]),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", UNLICENSE, ["free and unencumbered software"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", ZLIB, ["alter it and redistribute it freely"]),
]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass
class Index:
    """Postings of the templates' words. frequency: documents with the word, of total documents."""

    frequency: dict[bytes, int]
    total: int
    templates: list = field(default_factory=lambda: TEMPLATES)
    share: float = 0.7

    def __post_init__(self) -> None:
        self.words = [words_of(text) for _, text, _ in self.templates]
        self.keys = [[words_of(key) for key in keys] for _, _, keys in self.templates]
        self.base = [(words_of(phrase), label) for phrase, label in BASE.items()]
        known = {w for words in self.words for w in words} | {w for words, _ in self.base for w in words}
        self.idf = {w: math.log((1 + self.total) / (1 + self.frequency.get(w, 0))) + 1e-6 for w in known}
        rare = lambda w: (self.idf[w], w)
        self.whole = [sum(self.idf[w] for w in words) for words in self.words]
        self.slack = [2 + len(words) // 10 for words in self.words]
        #: For each template the positions of each of its words; for each anchor where it stands in which templates.
        self.postings: list[dict[bytes, list[int]]] = []
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            places: dict[bytes, list[int]] = {}
            for k, w in enumerate(words):
                places.setdefault(w, []).append(k)
            self.postings.append(places)
            # The rarest words, until those left out weigh less than the share: no notice at the share is without all of these.
            left, enough = self.whole[t], self.share * self.whole[t] * (1 - 1e-9)
            for word in sorted(places, key=rare, reverse=True):
                if left < enough:
                    break
                left -= self.idf[word] * len(places[word])
                self.anchors.setdefault(word, []).extend((t, k) for k in places[word])
        self.base_anchor = [max(range(len(words)), key=lambda k: rare(words[k])) for words, _ in self.base]
        self.wanted = self.anchors.keys() | {words[k] for (words, _), k in zip(self.base, self.base_anchor, strict=True)}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, tuple[float, int]]]:
        """Places of base phrases (start, label); for each label of a template its best score and start."""
        at: dict[bytes, list[int]] = {}
        wanted = self.wanted
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        places: list[tuple[int, str]] = []
        found: dict[str, tuple[float, int]] = {}
        if not at:
            return places, found
        for (phrase, label), k in zip(self.base, self.base_anchor, strict=True):
            places += [(i - k, label) for i in at.get(phrase[k], ()) if i >= k and words[i - k : i - k + len(phrase)] == phrase]
        # The file's licence words, the rarest first, and the places that their postings propose.
        proposed = {(t, i - k): None for w in sorted(at, key=lambda w: (-self.idf[w], w)) for t, k in self.anchors.get(w, ()) for i in at[w]}
        for t, start in proposed:
            first, last = max(0, start - self.slack[t]), max(0, start + len(self.words[t]) + self.slack[t])
            window = words[first:last]
            if not all(_stands(key, window) for key in self.keys[t]):
                continue
            share = self.agreement(t, window, first - start) / self.whole[t]
            if share >= self.share:
                label, new = self.templates[t][0], (min(share, 1.0), -max(0, start))
                found[label] = max(found.get(label, new), new)
        return places, {label: (score, -start) for label, (score, start) in found.items()}

    def agreement(self, t: int, window: list[bytes], shift: int) -> float:
        """The greatest weight of words that window and template share in order, each within slack of its relative position.

        shift: the position in the template that the window's first word would have. The matches are taken by the file's
        order; a frontier (positions rising, weights rising) holds the best weight up to each position of the template.
        """
        postings, slack, idf = self.postings[t], self.slack[t], self.idf
        ends: list[int] = []
        weights: list[float] = []
        for j, w in enumerate(window):
            here = j + shift
            made = []
            for k in postings.get(w, ()):
                if abs(here - k) <= slack:
                    i = bisect_left(ends, k)  # those that end before k
                    made.append((k, (weights[i - 1] if i else 0.0) + idf[w]))
            for k, weight in made:
                i = bisect_left(ends, k)
                if i < len(ends) and ends[i] == k:
                    if weights[i] >= weight:
                        continue
                    weights[i] = weight
                elif i and weights[i - 1] >= weight:
                    continue
                else:
                    ends.insert(i, k)
                    weights.insert(i, weight)
                while i + 1 < len(ends) and weights[i + 1] <= weight:
                    del ends[i + 1], weights[i + 1]
        return weights[-1] if weights else 0.0


def _stands(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Documents that hold each of the templates' words, and all documents: as many rows as the templates have words."""
    ship(docs.sparkSession)
    known = Index({}, 0).idf.keys()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, dict.fromkeys(known, 0)
        for batch in slices(batches, "text", 4 << 20):
            for text in column(batch, "text").to_pylist():
                total += 1
                for w in seen.keys() & set(words_of(text)):
                    seen[w] += 1
        rows = [(w.decode(), n) for w, n in seen.items()] + [("", total)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64()), strict=True)], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {r["word"].encode(): r["n"] for r in counted.collect()}
    return rows, rows.pop(b"", 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base_places and findings, each an array of structs."""
    ship(docs.sparkSession)
    index = Index(*frequencies(docs))
    schema = "doc_id long, n_words long, base_places array<struct<word:long,label:string>>, findings array<struct<label:string,score:double,word:long>>"
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("word", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            n, bases, finds = [], [], []
            for text in column(batch, "text").to_pylist():
                words = words_of(text)
                places, found = index.scan(words)
                n.append(len(words))
                bases.append([{"word": i, "label": label} for i, label in sorted(places)])
                finds.append([{"label": label, "score": score, "word": i} for label, (score, i) in sorted(found.items())])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(x, k) for x, k in zip((n, bases, finds), kinds[1:], strict=True))], names=["doc_id", "n_words", "base_places", "findings"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def digest(scanned: DataFrame) -> DataFrame:
    """One row of figures and labels for each document."""
    base = F.array_sort(F.array_distinct(F.transform("base_places", lambda x: x["label"])))
    every = F.array_sort(F.array_union(base, F.transform("findings", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(F.transform("base_places", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base_places", lambda x: x["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        best.alias("score"),
    )

"""Licence scan by a positional index of rare licence words.

The templates make one index: word -> (template, place in it). Words are ranked by inverse document frequency (IDF) over the whole corpus
scanned, for which the documents that hold each word of the templates are counted first; a count for each such word is all that
comes to the driver. Of every template only its ``ANCHORS`` highest-IDF words stand in the index. A file's words are looked up;
a posting proposes that its template starts at (place in the file - place in the template). Postings that agree on that
start are intersected, and a proposal is verified where the template's mandatory phrase must stand, word for word. Anchors lie in that phrase,
so a phrase that stands is always proposed, whatever the corpus' frequencies are.

Where its phrase stands, a template gives its label, and counts the words that stand at their places relative to the phrase: m of its n
words score m / n * (1 - 2 ** (-m / ``HALF``)), so a whole licence text scores near 1, a bare mention little. A file's score is its best
template's, rounded to six places; 0 without any.

Null and empty texts have no words, no labels and score 0. Texts are scanned whole; repeated rows give equal rows; an empty table gives none; extra
columns pass through, but for those named as a result, which give way. No shuffle but that of the counts.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_size

#: Words are runs of what these bytes aren't, after A-Z are lower-cased: fixed values.
BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in BREAKS else b for b in range(256))
#: Words of a template that stand in the index, highest IDF first; proposals need ``AGREE`` of them, or all of a shorter template.
ANCHORS, AGREE = 4, 2
#: Words at their places that halve what a score lacks of its template's share.
HALF = 8

#: Base phrases and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, mandatory phrase, and public licence text or notice around it: fixed values.
TEMPLATES = [
    ("mit", "mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", "redistribution and use in source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", """Neither the name of the copyright holder
        nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc", "permission to use copy modify and or distribute this software", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", "altered source versions must be plainly marked as such", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of
        the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
        derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""),
    ("unlicense", "free and unencumbered software released into the public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("public-domain", "released into the public domain", "released into the public domain"),
    ("apache-2.0", "apache license version 2 0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
        the License."""),
    ("mpl-2.0", "mozilla public license v 2 0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("gpl-notice", "redistribute it and or modify it under the terms of the gnu general public license", """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("gpl-2", "general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "general public license version 3", "gnu general public license version 3"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("agpl", "affero general public license", "gnu affero general public license"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd"),
    ("cc0", "cc0", "cc0 1 0 universal"),
]


def licence_words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase: tuple[bytes, ...]
    phrase_at: int
    need: int
    base: bool


@functools.cache
def templates() -> tuple[Template, ...]:
    """The base phrases, each its own template, and the others; which words are anchors is for index() to say."""
    out = []
    for label, phrase, text, base in [*((label, x, x, True) for x, label in BASE.items()), *((*x, False) for x in TEMPLATES)]:
        words, must = tuple(licence_words(text)), tuple(licence_words(phrase))
        at = next(k for k in range(len(words)) if words[k : k + len(must)] == must)
        out.append(Template(label, words, must, at, min(AGREE, ANCHORS, len(must)), base))
    return tuple(out)


def index(frequency: dict[bytes, int], documents: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each anchor word its postings (template, place), by the documents that hold each word."""
    idf = lambda w: math.log((1 + documents) / (1 + frequency.get(w, 0)))
    postings = defaultdict(list)
    for t, one in enumerate(templates()):
        # anchors lie in the phrase, so that a phrase which stands always brings enough of them
        places = sorted(range(one.phrase_at, one.phrase_at + len(one.phrase)), key=lambda k: (-idf(one.words[k]), k))[:ANCHORS]
        for k in places:
            postings[one.words[k]].append((t, k))
    return dict(postings)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the templates, and all documents."""
    known = frozenset(w for one in templates() for w in one.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for part in by_size(batches, 0, 4_000_000):
            for one in part.column(0).to_pylist():
                count.update(known.intersection(licence_words(one)))
                count[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    found = {bytes(r.word): r.n for r in docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


def weight(standing: int, size: int) -> float:
    return standing / size * (1 - 2 ** (-standing / HALF))


def scan(found: list[bytes], postings: dict[bytes, list[tuple[int, int]]]) -> tuple[list[tuple[str, int, bool]], float]:
    """Places of templates in a file's words, as (label, start of the phrase, whether a base phrase), and the score."""
    known = templates()
    votes: Counter = Counter()
    for place, word in enumerate(found):
        if word in postings:
            for t, k in postings[word]:
                votes[t, place - k] += 1
    hits, score = [], 0.0
    for (t, start), n in votes.items():
        one = known[t]
        at = start + one.phrase_at
        if n < one.need or at < 0 or tuple(found[at : at + len(one.phrase)]) != one.phrase:
            continue
        standing = sum(0 <= start + k < len(found) and found[start + k] == w for k, w in enumerate(one.words))
        hits.append((one.label, at, one.base))
        score = max(score, weight(standing, len(one.words)))
    return hits, round(score, 6)


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.LongType())),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


def licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with its number of words, the places of base phrases, base labels, all labels and the score."""
    handed = docs.sparkSession.sparkContext.broadcast(index(*frequencies(docs, text)))
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in RESULT.fieldNames()]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *RESULT.fields])
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, len(names), 4_000_000):
            columns: list[list] = [[] for _ in types]
            for one in part.column(len(names)).to_pylist():
                found = licence_words(one)
                hits, score = scan(found, handed.value)
                places = sorted(at for _, at, base in hits if base)
                for column, value in zip(columns, (len(found), places, sorted({x for x, _, base in hits if base}), sorted({x for x, _, _ in hits}), score), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.fieldNames())

    return docs.select(*names, docs[text].alias("__text")).mapInArrow(run, schema)

"""Licence scans with a positional rare-token index.

Templates are public notices, whole ones and their first sentences. The index keeps, for
each template word, its postings (template, position). For a file the words of each
template that could be confirmed are looked up, those with the highest inverse document
frequency (counted over the whole corpus) first and as many as no alignment of FLOOR or
more can miss. Their positions in the file minus their
positions in the template propose alignments, and an alignment counts only where one of
the template's mandatory key phrases stands near it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import map_batches, table, utf8

#: Any byte that ends a word becomes a space; A-Z become a-z; bytes above 127 belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: phrase -> label of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> (notice, key phrases of which one must stand in the aligned region)
TEMPLATES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge",)),
    "mit-short": ("Released under the MIT License", ("mit license",)),
    "apache": ("Licensed under the Apache License, Version 2.0", ("apache license version 2 0", "apache license 2 0")),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license as published",)),
    "gpl-short": ("Licensed under the GNU General Public License version 3", ("gnu general public license v3", "gnu general public license version 3", "gnu general public license version 2")),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0", ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0")),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", ("cc by nc",)),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", ("cc by sa",)),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    "proprietary": ("Copyright. All rights reserved. Proprietary and confidential", ("all rights reserved",)),
}
#: Whole notices, under the label before "-full".
TEMPLATES |= {
    "mit-full": (
        TEMPLATES["mit"][0] + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "this permission notice shall be included in all copies"),
    ),
    "bsd-full": (
        TEMPLATES["bsd"][0] + """:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    "apache-full": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("apache license version 2 0", "apache org licenses license 2 0"),
    ),
    "gpl-full": (
        TEMPLATES["gpl"][0] + """, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        ("gnu general public license as published", "a copy of the gnu general public license along with this program"),
    ),
    "mpl-full": (
        TEMPLATES["mpl"][0] + ". If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license", "mozilla org mpl 2 0"),
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ("for any purpose with or without fee is hereby granted",),
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software released into the public domain",)),
}
#: What a template's name says beyond its label.
FORMS = ("-short", "-full")
FLOOR = 0.5


def label_of(name: str) -> str:
    for form in FORMS:
        name = name.removesuffix(form)
    return name


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


def compile_index(templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES) -> dict:
    """Postings by word and the templates' words and key phrases; bounded by the templates."""
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    entries = []
    for k, (label, (notice, keys)) in enumerate(sorted(templates.items())):
        own = words_of(notice)
        entries.append((label, own, [tuple(words_of(p)) for p in keys]))
        for at, w in enumerate(own):
            postings[w].append((k, at))
    for _, _, keys in entries:
        for w in {w for p in keys for w in p}:
            postings.setdefault(w, [])  # counted and looked up, without a place in a notice
    return {"postings": dict(postings), "entries": entries}


def phrase_starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions where ``phrase`` stands in words joined and framed by single spaces."""
    found, at, word, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = joined.find(phrase, at + 1)
    return found


def document_frequencies(texts: DataFrame, vocabulary: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Rows, and for each licence word the number of rows that hold it.

    Each task sends one count for each word of the vocabulary, which is that of the
    templates, so what reaches the driver is bounded by their length.
    """
    known = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                n.update(known.intersection(words_of(text)))
        words = [b"", *sorted(n)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([rows, *(n[w] for w in words[1:])], pa.int64())], names=["word", "n"])

    got = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in got}
    return counts.pop(b"", 0), counts


def scan_words(words: list[bytes], index: dict, idf: dict[bytes, float]) -> dict[str, float]:
    """label -> share of a template's words that stand where its best verified alignment puts them."""
    postings = index["postings"]
    places: dict[bytes, list[int]] = {w: [] for w in postings.keys() & set(words)}
    # a template can only be confirmed where all words of one of its key phrases occur
    open_to = {k for k, (_, _, keys) in enumerate(index["entries"]) if any(all(w in places for w in p) for p in keys)}
    places = {w: at for w, at in places.items() if any(k in open_to for k, _ in postings[w])}
    if not places:
        return {}
    for at, w in enumerate(words):
        if w in places:
            places[w].append(at)
    # an alignment of FLOOR or more misses too few places of a notice to miss all of these
    proposed: set[tuple[int, int]] = set()
    for k in open_to:
        own = index["entries"][k][1]
        rare = sorted(range(len(own)), key=lambda i: (-idf.get(own[i], 0.0), own[i], i))[: math.floor(len(own) * (1 - FLOOR)) + 1]
        proposed.update((k, here - i) for i in rare for here in places.get(own[i], ()))
    best: dict[str, float] = {}
    n = len(words)
    for k, shift in sorted(proposed):
        label, own, keys = index["entries"][k]
        score = sum(1 for i, w in enumerate(own) if 0 <= shift + i < n and words[shift + i] == w) / len(own)
        if score <= best.get(label, FLOOR - 1e-9):
            continue
        lo, hi = max(0, shift - 4), min(n, shift + len(own) + 4)
        near = words[lo:hi]
        if any(tuple(near[i : i + len(p)]) == p for p in keys for i in range(len(near) - len(p) + 1)):
            best[label] = score
    return best


def scan(text: str | None, index: dict, idf: dict[bytes, float]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        if found := phrase_starts(joined, b" " + phrase.encode() + b" "):
            starts += found
            base.add(label)
    more = {label_of(k): v for k, v in sorted(scan_words(words, index, idf).items(), key=lambda x: x[1])}
    score = max([*more.values(), 0.5 if base else 0.0])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), float(score)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES) -> DataFrame:
    """Licence labels of each row's whole text.

    Null or empty text: no words, no label, score 0. Null ids and repeated rows are kept;
    other columns are not read. score: the best verified alignment, 0.5 for a base phrase alone.
    """
    index = compile_index(templates)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows_in, df = document_frequencies(texts.select("text"), list(index["postings"]))
    idf = {w: math.log((1 + rows_in) / (1 + df.get(w, 0))) for w in index["postings"]}
    names = "n_words n_base first_word last_word base_labels labels score".split()

    def rows(b: dict[str, list]) -> dict[str, list]:
        got = [scan(t, index, idf) for t in b["text"]]
        return {"doc_id": b["doc_id"]} | {n: [g[i] for g in got] for i, n in enumerate(names)}

    kind = dict(texts.dtypes)["doc_id"]
    return map_batches(texts, rows, f"doc_id {'long' if kind == 'bigint' else kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Base places, labels of the index and their score, of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))

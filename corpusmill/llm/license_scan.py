"""License scans by a positional rare-token index, in built-in functions only.

Base labels come from fixed phrases, wherever their words stand consecutively.
The index adds labels.  Licence templates are word sequences, whole licence
texts, notices and usual sentences; the index holds for each of their words its
templates and places in them.  For each file and template the words that both
have are ranked by inverse document frequency *in the scanned table*, and the
``most`` rarest are looked up: every place of such a word in the file speaks for
(template, place in the file - place in the template).  Postings of the
template's words are so intersected by relative position.  Where at least half
of the words agree on one place of the template, and its mandatory phrase stands
exactly where the template has it, the template's label is added.

Everything happens within a row but for counting document frequencies of the
template words (a few hundred), so there is no shuffle of texts.  Files that
hold no mandatory phrase anywhere are not looked up.

Defined cases: a null or empty text has no words and no labels; long texts are
scanned whole; words of equal frequency rank by their place in the template;
templates that tie each add their label; repeated rows each get their row; other
columns pass through (one named ``_lic`` too: the result is then in ``_lic_``);
an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, whole_row, word_array

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of public licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at http://mozilla.org/MPL/2.0/."""

#: label, template, phrase that must stand in the file where the template has it.
TEMPLATES = (
    ("mit", _MIT, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the MIT license", "mit license"),
    ("mit", "licensed under the MIT license", "mit license"),
    ("bsd-3-clause", _BSD + _BSD_THIRD + _BSD_END, "may be used to endorse or promote products derived from this software"),
    ("bsd", _BSD, "redistribution and use in source and binary forms"),
    ("isc", _ISC, "permission to use copy modify"),
    ("zlib", _ZLIB, "the origin of this software must not be misrepresented"),
    ("apache-2.0", _APACHE, "apache license version 2 0"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl-3.0", _GPL.format(3), "either version 3 of the license"),
    ("gpl-2.0", _GPL.format(2), "either version 2 of the license"),
    ("gpl-3.0", "licensed under the GNU General Public License version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License version 2", "general public license version 2"),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "under the terms of the gnu general public license"
    ),
    ("lgpl", _GPL.format(3).replace("General Public", "Lesser General Public"), "under the terms of the gnu lesser general public license"),
    ("agpl", _GPL.format(3).replace("General Public", "Affero General Public"), "under the terms of the gnu affero general public license"),
    ("mpl-2.0", _MPL, "mozilla public license"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International license", "creative commons attribution"),
    ("cc0", "to the extent possible under law, the author has waived all copyright and related rights", "to the extent possible under law"),
    ("unlicense", _UNLICENSE, "software released into the public domain"),
    ("boost", _BOOST, "boost software license"),
    ("boost", "distributed under the Boost Software License, Version 1.0", "boost software license"),
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Template:
    """A template's words, the first place of each, and where its mandatory phrase stands."""

    def __init__(self, label: str, text: str, phrase: str):
        self.label, self.phrase = label, phrase
        self.words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        self.place: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.place.setdefault(w, i)
        key = phrase.split()
        at = [i for i in range(len(self.words) - len(key) + 1) if self.words[i : i + len(key)] == key]
        if not at:
            raise ValueError(f"the phrase {phrase!r} does not stand in its template")
        self.key_at, self.key_size = at[0], len(key)

    def by_rarity(self, frequencies: dict[str, int]) -> list[str]:
        """Its words, those in the fewest rows first, then by place."""
        return sorted(self.place, key=lambda w: (frequencies.get(w, 0), self.place[w]))


def document_frequencies(df: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """In how many rows each of the given words occurs. One row for each word comes back, whatever the table's size."""
    found = df.select(F.explode(F.array_intersect(word_array(F.col(text_col)), F.array(*map(F.lit, words)))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def _phrase_places(words: Column, joined: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often, and at which words first and last, a phrase's words stand consecutively."""
    there = joined.contains(f" {phrase} ")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    n = F.when(there, F.regexp_count(joined, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long")
    first = F.when(there, spaces(F.substring_index(joined, f" {phrase} ", 1))).cast("long")
    last = F.when(there, F.size(words) - spaces(F.substring_index(joined, f" {phrase} ", -1)) - len(phrase.split())).cast("long")
    return n, first, last


def scan(df: DataFrame, text_col: str = "text", templates=TEMPLATES, base=BASE, frequencies: dict[str, int] | None = None, most: int = 6) -> DataFrame:
    """df with a struct column ``_lic``: n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` holds (label, word, votes, of): where each template would begin,
    how many of the words looked up agreed on that and how many there were.
    ``score`` is 1 with a base label, else the largest share of agreeing words.
    """
    parsed = [Template(*t) for t in templates]
    vocabulary = sorted({w for t in parsed for w in t.place})
    if frequencies is None:
        frequencies = document_frequencies(df, text_col, vocabulary)
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    index = F.create_map(
        *[
            x for w in vocabulary for x in (
                F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p.place[w]).alias("p")) for t, p in enumerate(parsed) if w in p.place])
            )
        ]
    ) if vocabulary else None
    step = 1 << 40  # one code a posting: template above, offset below
    w = df.select(whole_row(df), word_array(F.col(text_col)).alias("words"))
    w = w.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    places = [_phrase_places(F.col("words"), F.col("joined"), p) for p, _ in base]
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), (_, label) in zip(places, base, strict=True)])))
    # a template whose phrase is nowhere in the joined words cannot match: files without any phrase are not looked up
    some = F.lit(False)
    for m in sorted({t.phrase for t in parsed}):
        some = some | F.col("joined").contains(f" {m} ")
    # of each template the rarest words that the file has; array_intersect keeps the order of its first argument
    looked = F.array(*[F.slice(F.array_intersect(strings(t.by_rarity(frequencies)), F.col("words")), 1, most) for t in parsed])
    w = w.withColumn("looked", F.when(some, looked).otherwise(F.array().cast("array<array<string>>")))
    w = w.withColumn("wanted", F.array_distinct(F.flatten("looked")))
    seen = F.filter(F.transform("words", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.col("wanted"), x["w"]))
    mine = lambda o: F.filter(index[o["w"]], lambda p: F.array_contains(F.get(F.col("looked"), p["t"]), o["w"]))
    codes = F.array_sort(
        F.flatten(F.transform(seen, lambda o: F.transform(mine(o), lambda p: p["t"].cast("long") * step + (step // 2) + o["i"] - p["p"])))
    ) if vocabulary else F.array().cast("array<long>")
    w = w.withColumn("codes", F.when(F.size("wanted") > 0, codes).otherwise(F.array().cast("array<long>")))
    starts = F.filter(F.transform("codes", lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(F.col("codes"), x["i"] - 1) != x["c"]))
    w = w.withColumn("starts", starts)
    votes = F.transform(
        "starts",
        lambda s, j: F.struct(
            F.floor(s["c"] / F.lit(step)).cast("int").alias("t"),
            (s["c"] % step - step // 2).cast("int").alias("word"),
            (F.coalesce(F.get(F.col("starts"), j + 1)["i"], F.size("codes")) - s["i"]).cast("int").alias("votes"),
        ),
    )
    w = w.withColumn("votes", F.filter(votes, lambda v: v["votes"] * 2 >= F.size(F.get(F.col("looked"), v["t"]))))
    key_at, key_size = (F.array(*[F.lit(x) for x in xs]) for xs in ([t.key_at for t in parsed], [t.key_size for t in parsed]))
    begin = lambda v: v["word"] + F.get(key_at, v["t"])
    stands = lambda v: (begin(v) >= 0) & (
        F.array_join(
            F.slice(F.col("words"), F.greatest(begin(v), F.lit(0)) + 1, F.get(key_size, v["t"])), " "
        ) == F.get(strings([t.phrase for t in parsed]), v["t"])
    )
    good = F.filter("votes", stands)
    matches = F.transform(
        good,
        lambda v: F.struct(
            F.get(strings([t.label for t in parsed]), v["t"]).alias("label"), v["word"].alias("word"), v["votes"].alias("votes"),
            F.size(F.get(F.col("looked"), v["t"])).alias("of")
        )
    )
    w = w.withColumn("matches", matches)
    n_base = sum((n for n, _, _ in places[1:]), places[0][0])
    share = F.coalesce(F.array_max(F.transform("matches", lambda m: m["votes"] / m["of"])), F.lit(0.0))
    out = F.struct(
        F.size("words").cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.least(*[f for _, f, _ in places]).alias("first_word"),
        F.greatest(*[x for _, _, x in places]).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(share).alias("score"),
        F.col("matches"),
    )
    return w.select("row.*", out.alias(free(df, "_lic")))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence scan of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)
    return out.select("doc_id", *[F.col(f"_lic.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])

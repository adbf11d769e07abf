"""Licence scan: segments of documents against licence templates, by the Dice coefficient of their word bigrams
(DataFrame functions only).

Segments are the whole text, its paragraphs and its lines.  They and the templates are normalised alike (lower case,
runs of other characters than letters and digits are one space, numbers stay).  With n and m distinct bigrams, of
which c are shared, the coefficient is 2c / (n + m).  As c is at most the smaller of n and m, a template of m bigrams
can reach the threshold t only for n between m * t / (2 - t) and m * (2 - t) / t, and each bigram meets only templates
within its segment's bounds.  As a match shares at least t / (2 - t) of a template's bigrams, it holds one of a few
anchor words (`anchors`); documents and segments without any are passed over before they are split or normalised.

Notices that fill none of these are found by runs of consecutive units, which are sentences cut at line breaks: runs
where the bigrams of one template lie dense enough (`runs`).  A run adds a licence only where the document's segments
have not found it, and counts as one segment, the best.  Where a template holds that of another licence (BSD-3-Clause
that of BSD-2-Clause), the inner licence's run is passed over if it holds a better one of its own or lies within a run
of the outer licence.

The templates are a fixed table (a few hundred bigrams), so they are broadcast; the documents' bigrams aren't moved,
only the rare shared ones are counted by segment.

Cases: null, empty and one-word texts have no bigram and match nothing; very long texts are searched whole, and only their
dense places become strings; a segment that ties goes to the first licence
by name; the same segment in a document counts once; rows that repeat doc_id and text are one; columns besides doc_id
and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.llm.util import materialize

#: Fixed: public licence texts by SPDX name: grants, warranties, and notices that stand for a licence.
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
#: Fixed: licences whose full text is the grant among the notices and a warranty.
FULL = {"MIT": MIT_WARRANTY, "BSD-2-Clause": BSD_WARRANTY, "BSD-3-Clause": BSD_WARRANTY, "ISC": ISC_WARRANTY}
TEMPLATES = NOTICES + tuple((name, max((t for n, t in NOTICES if n == name), key=len) + " " + more) for name, more in FULL.items())
PERCENT = 80


def with_texts(spark: SparkSession, folder: str, templates=TEMPLATES) -> tuple:
    """templates and the texts of a folder, each named by its SPDX name (ISC.txt): other licences are given this way.

    The work on a document that holds a text grows with the square of the text's lines: for texts of some hundred words.
    """
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return (*templates, *sorted((r["name"].removesuffix(".txt"), r["value"]) for r in rows))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    words = F.split(text, " ")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def plain_here(text: str) -> list[str]:
    """The same on the driver, for the templates."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def template_rows(templates=TEMPLATES) -> list[tuple]:
    """(template, license, m, bigram)."""
    return [(k, name, len(grams), g) for k, (name, text) in enumerate(templates) for grams in [plain_here(text)] for g in grams]


def anchors(templates=TEMPLATES, percent: int = PERCENT) -> set[str]:
    """Words of which every match holds at least one.

    A match shares at least t / (2 - t) of a template's bigrams.  Words are taken, longest first, until the bigrams
    without any of them are fewer than that, so no match can do without all of them.
    """
    out: set[str] = set()
    for _, text in templates:
        left = [set(g.split(" ")) for g in plain_here(text)]
        need = -(-len(left) * percent // (200 - percent))
        while len(left) >= need and left:
            word = max({w for g in left for w in g}, key=lambda w: (w in out, len(w), sum(w in g for g in left), w))
            out.add(word)
            left = [g for g in left if word not in g]
    return out


def segments(text: Column) -> Column:
    """The text, its paragraphs and its lines, each once."""
    parts = F.array_union(F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_union(F.array(text), parts)


def bounds(templates=TEMPLATES, percent: int = PERCENT) -> tuple[int, int]:
    """Fewest and most bigrams of a segment that can match."""
    sizes = {m for *_, m, _ in template_rows(templates)}
    low, high = percent, 200 - percent  # t and 2 - t, in hundredths
    return min(-(-m * low // high) for m in sizes), max(m * high // low for m in sizes)


def anchor_pattern(templates=TEMPLATES, percent: int = PERCENT) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(anchors(templates, percent)))})(?![\p{{L}}\p{{N}}])"


def holding(templates=TEMPLATES) -> list[tuple]:
    """(inner, outer): licences of which a template of the outer one has all bigrams of one of the inner and more."""
    known = [(name, set(plain_here(text))) for name, text in templates]
    return sorted({(a, b) for a, x in known for b, y in known if a != b and x < y})


def units_of(text: Column) -> Column:
    """Normalised sentences of a text, cut at line breaks too."""
    return F.filter(F.transform(F.split(text, r"\n|(?<=[.!?;:])\s+"), plain), lambda u: u != "")


def runs(some: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, rk, segment (normalised), i, j (first and last unit): runs of units that may match a template.

    Shared bigrams are found by position first.  A run is made only where one template's lie dense enough: it begins and
    ends with units that hold one, holds as many distinct ones as a match needs, and has at most (2 - t) / t times the
    template's words.  Other runs of the template have no more shared bigrams and are longer, so none is better.
    """
    low, high = percent, 200 - percent
    spark, known = some.sparkSession, []
    for k, name, m, gram in template_rows(templates):
        known.append((k, gram, -(-m * low // high), len(re.sub(r"[\W_]+", " ", templates[k][1]).split()) * high // low))
    known = F.broadcast(spark.createDataFrame(known, "template int, gram string, need int, most int"))
    cut = some.select("doc_id", F.xxhash64("text").alias("rk"), F.explode(F.array(units_of(F.col("text")))).alias("units")).where(F.size("units") > 0)
    cut = cut.dropDuplicates(["doc_id", "rk"])
    split = F.transform("units", lambda u: F.split(u, " "))
    worded = cut.select("doc_id", "rk", F.explode(F.array(F.struct(F.flatten(split).alias("words"), F.flatten(F.transform(split, lambda w, k: F.array_repeat(k, F.size(w)))).alias("owner")))).alias("t")).select("doc_id", "rk", "t.*").where(F.size("words") > 1)
    n = F.size("words") - 1
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = worded.select("doc_id", "rk", F.posexplode(F.arrays_zip(pairs.alias("gram"), F.slice("owner", F.lit(1), n).alias("a"), F.slice("owner", F.lit(2), n).alias("b"))).alias("w", "p"))
    placed = placed.select("doc_id", "rk", "w", F.col("p.gram").alias("gram"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    hit = F.struct("w", "a", "b", "gram")
    # the shared bigrams of a document and a template, in order; only where there are enough of them at all
    held = placed.join(known, "gram").groupBy("doc_id", "rk", "template", "need", "most").agg(F.array_sort(F.collect_list(hit)).alias("hits")).where(F.size(F.array_distinct("hits.gram")) >= F.col("need"))
    # where a run may begin: the first shared bigram of its unit, with as many as needed within the most words
    at = held.select("doc_id", "rk", "need", "most", "hits", F.explode(F.sequence(F.lit(0), F.size("hits") - F.col("need"))).alias("s"))
    first, last = F.col("hits")[F.col("s")], F.col("hits")[F.col("s") + F.col("need") - 1]
    begins = ((F.col("s") == 0) | (F.get("hits", F.col("s") - 1)["a"] < first["a"])) & (last["w"] - first["w"] + 2 <= F.col("most"))
    near = at.where(begins).select("doc_id", "rk", "need", "most", F.explode(F.array(F.slice("hits", F.col("s") + 1, F.col("most")))).alias("near"))
    # where it may end: the last shared bigram that lies within its unit
    ends = F.filter(F.sequence(F.col("need") - 1, F.size("near") - 1), lambda e: (F.get("near", e)["w"] - F.col("near")[0]["w"] + 2 <= F.col("most")) & F.coalesce(F.get("near", e + 1)["b"] > F.get("near", e)["b"], F.lit(True)) & (F.size(F.array_distinct(F.transform(F.slice("near", F.lit(1), e + 1), lambda h: h["gram"]))) >= F.col("need")))
    found = near.where(F.size("near") >= F.col("need")).select("doc_id", "rk", "near", F.explode(ends).alias("e")).select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("near")[0]["a"].alias("i"), F.get("near", F.col("e"))["b"].alias("j")).distinct()
    found = materialize(found, "dense")  # few: notices, not prose
    met = cut.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r")))
    return met.select("doc_id", "rk", "i", "j", F.array_join(F.slice("units", F.col("i") + 1, F.col("j") - F.col("i") + 1), " ").alias("segment"))


def scored(normal: DataFrame, templates=TEMPLATES, percent: int = PERCENT, place: tuple = ()) -> DataFrame:
    """doc_id, rk, segment, license, dice_pm of normalised segments; place: columns that tell equal segments apart."""
    keys = ["doc_id", "rk", "segment", *place]
    spark: SparkSession = normal.sparkSession
    known = F.broadcast(spark.createDataFrame(template_rows(templates), "template int, license string, m int, gram string"))
    low, high = percent, 200 - percent
    grams = normal.select(*keys, F.explode(F.array(bigrams(F.col("segment")))).alias("grams")).withColumn("n", F.size("grams"))
    fit = grams.where(F.col("n").between(*bounds(templates, percent)))
    shared = fit.select(*keys, "n", F.explode("grams").alias("gram")).join(known, "gram").where((F.col("n") * high >= F.col("m") * low) & (F.col("n") * low <= F.col("m") * high))
    # A segment counts once per document, however often it or its row comes: shared bigrams are counted distinct.
    counted = shared.groupBy(*keys, "n", "template", "license", "m").agg(F.count_distinct("gram").alias("c"))
    good = counted.where(200 * F.col("c") >= percent * (F.col("n") + F.col("m")))
    best = Window.partitionBy(*keys).orderBy((F.col("c") / (F.col("n") + F.col("m"))).desc(), "license", "template")
    return good.withColumn("k", F.row_number().over(best)).where("k = 1").select(*keys, "license", F.floor(2000 * F.col("c") / (F.col("n") + F.col("m"))).cast("int").alias("dice_pm"))


def matches(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, rk, segment (normalised), license, dice_pm (per mille, rounded down): the best template of each segment that reaches percent, and the best run of each licence that no segment has."""
    word = anchor_pattern(templates, percent)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.lower("text").rlike(word))
    parts = some.select("doc_id", F.xxhash64("text").alias("rk"), F.explode(segments(F.col("text"))).alias("part"))
    # Generators keep the steps apart, so that each normalises and splits once.
    normal = parts.where(F.lower("part").rlike(word)).select("doc_id", "rk", F.explode(F.array(plain(F.col("part")))).alias("segment"))
    whole = materialize(scored(normal, templates, percent), "segments")
    run = materialize(scored(runs(some, templates, percent), templates, percent, ("i", "j")), "runs")
    found = whole.select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("license").alias("has")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r"))
    new = run.join(found, same & (F.col("license") == F.col("has")), "left_anti")
    if pairs := holding(templates):
        # (inner, other): the outer licence's runs, and the inner one's own better runs.
        rows = [(a, b, True) for a, b in pairs] + [(a, a, False) for a in sorted({a for a, _ in pairs})]
        inside = F.broadcast(docs.sparkSession.createDataFrame(rows, "inner string, other string, outer boolean"))
        other = run.join(inside, F.col("license") == F.col("other")).select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), "inner", "outer", F.col("i").alias("from"), F.col("j").alias("to"), F.col("dice_pm").alias("pm"))
        within = F.col("outer") & (F.col("from") <= F.col("i")) & (F.col("to") >= F.col("j"))
        worse = ~F.col("outer") & (F.col("from") >= F.col("i")) & (F.col("to") <= F.col("j")) & (F.col("pm") > F.col("dice_pm"))
        new = new.join(other, same & (F.col("license") == F.col("inner")) & (within | worse), "left_anti")
    best = Window.partitionBy("doc_id", "rk", "license").orderBy(F.col("dice_pm").desc(), F.length("segment"), "segment")
    return whole.unionByName(new.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "i", "j"))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, n_segments, dice_pm (of the best segment): one row for each document and licence found in it."""
    return matches(docs, templates, percent).groupBy("doc_id", "license").agg(F.count("*").alias("n_segments"), F.max("dice_pm").alias("dice_pm"))

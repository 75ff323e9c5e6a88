"""Licence notices by Dice coefficient over word bigrams, in DataFrame operations only.

A text is compared by its parts: every line, and every paragraph of several lines; a line without a letter or digit, such as
a bare comment leader, parts paragraphs. A part and a template match when 2 * common / (bigrams of part + bigrams of
template) >= ``NUM / DEN`` over distinct word bigrams of normalised text. A part whose number of bigrams lies outside
[t / (2 - t), (2 - t) / t] times a template's cannot reach t, so it is not compared with it; what is left meets only the
templates it shares a bigram with. The templates are fixed, hence broadcast.

A part that reaches t misses at most ``spare`` = m - ceil(t m / (2 - t)) of a template's m bigrams. So it holds one
word of any set of words that stand in more of them together. ``needed_words`` is such a set of each template; texts, and then
parts, without any of these words are left aside before anything is cut or normalised.

Normalised: lower case, years left out, everything but letters and digits as blanks.

Defined results: null and empty texts, and parts of fewer than two words, match nothing; rows of one doc_id count together;
a null doc_id is reported as null; equal coefficients of several templates are all reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUM, DEN = 4, 5

#: The wording of licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}

#: Words that many texts hold and no licence is told by.
COMMON = frozenset("the of and to in is that for it with as was on are be this by from at or all any not no an a under other such so use work into has if shall may can you your".split())


def normalised_words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"\b(?:19|20)\d\d\b|[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " +"), "")


def bigrams(words: Column) -> Column:
    """Distinct bigrams; none from a single word."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(firsts, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def template_table(spark: SparkSession, templates: dict[str, str], num: int, den: int) -> DataFrame:
    """template, size, least, most, bigram."""
    texts = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(t).alias("text")) for k, t in templates.items()])
    rows = spark.range(1).select(F.inline(texts)).withColumn("g", bigrams(normalised_words(F.col("text")))).withColumn("size", F.size("g"))
    least = F.ceil(F.col("size") * num / (2 * den - num)).cast("int")
    most = F.floor(F.col("size") * (2 * den - num) / num).cast("int")
    return rows.select("template", "size", least.alias("least"), most.alias("most"), F.explode("g").alias("bigram"))


def needed_words(templates: list[list[str]], num: int, den: int) -> list[str]:
    """Words, rather not ``COMMON`` ones, of which each part that matches a template holds one. templates: their bigrams."""
    chosen: list[str] = []
    for grams in sorted(filter(None, templates), key=len):
        spare = len(grams) - -(-num * len(grams) // (2 * den - num))
        of = {w: {g for g in grams if w in g.split(" ")} for g in grams for w in g.split(" ")}
        rare = {w: mine for w, mine in of.items() if w not in COMMON and not w.isdigit()}
        if len(set().union(*rare.values())) > spare:
            of = rare
        held = set().union(*(of[w] for w in chosen if w in of))
        while len(held) <= spare:
            chosen.append(max(of, key=lambda w: (len(of[w] - held), len(w), w)))
            held |= of[chosen[-1]]
    return sorted(chosen)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def parts(docs: DataFrame, words: list[str]) -> DataFrame:
    """row, doc_id, part (its place among these), g (bigrams), n: lines, and paragraphs of several lines, with one of words."""
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"
    some = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(F.lower("text").rlike(pattern))
    blocks = F.filter(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda p: p.contains("\n"))
    pieces = F.filter(F.concat(F.split("text", "\n"), blocks), lambda p: F.lower(p).rlike(pattern))
    # in the generator, and an outer one, so that no filter computes them again
    grams = F.transform(pieces, lambda p: let(normalised_words(p), bigrams))
    return some.select("row", "doc_id", F.posexplode_outer(grams).alias("part", "g")).withColumn("n", F.size("g"))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, num: int = NUM, den: int = DEN) -> DataFrame:
    """row, doc_id, part, template, common, dice: every part that matches a template."""
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES, num, den)
    bounds = known.agg(F.min("least").alias("x"), F.max("most").alias("y")).first()
    grams = known.groupBy("template").agg(F.sort_array(F.collect_list("bigram")).alias("grams")).orderBy("template").collect()
    held = parts(docs, needed_words([r["grams"] for r in grams], num, den)).where(F.col("n").between(bounds["x"], bounds["y"]))
    met = held.select("row", "doc_id", "part", "n", F.explode("g").alias("bigram")).join(F.broadcast(known), "bigram").where(F.col("n").between(F.col("least"), F.col("most")))
    found = met.groupBy("row", "doc_id", "part", "n", "template", "size").agg(F.count("*").alias("common"))
    return found.where(2 * den * F.col("common") >= num * (F.col("n") + F.col("size"))).select("row", "doc_id", "part", "template", "common", (2 * F.col("common") / (F.col("n") + F.col("size"))).alias("dice"))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, template, n_parts, best_dice: the licence notices of each document."""
    return license_matches(docs).groupBy("doc_id", "template").agg(F.count("*").alias("n_parts"), F.max("dice").alias("best_dice"))

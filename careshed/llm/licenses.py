"""License scans: windows of words against license templates by the Dice coefficient of word bigrams.

Only DataFrame operations. A window has as many words as the template and lies where a rare bigram of the template, an
anchor, stands in the document; so notices are found wrapped over lines, behind comment signs and inside longer lines.
A coefficient of t bounds the ratio of two bigram sets' sizes, so a document's window that is cut short by its end is
compared only with templates whose bounds it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careshed.llm.common import checked_broadcast, table, text_of

DICE = 0.75
#: Of windows that begin within so many words of each other the best is reported.
SLACK = 3
#: Anchors that may be broadcast (at most 16 MB with their templates); more are joined by a shuffle.
BROADCAST_ANCHORS = 20_000

#: The usual notices and the texts of short public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """The bigrams, in order; words has two or more."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))


def _anchors(spark: SparkSession, templates: dict[str, list[str]], dice: float) -> DataFrame:
    """(anchor, place, license, pattern, n_words): a row for each anchor of each template of two words or more.

    A window within the coefficient misses fewer than m + 1 of the template's bigrams, where m is a share of
    1 - dice / (2 - dice) of them; the m + 1 longest, as the rarest, are the anchors, so it holds one of them.
    """
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    t = spark.createDataFrame(rows, "license string, template_no int, notice string")
    t = t.withColumn("words", _words(F.lower("notice"))).where(F.size("words") > 1).withColumn("pairs", _pairs(F.col("words")))
    t = t.select("license", "template_no", F.size("words").alias("n_words"), "pairs", F.array_distinct("pairs").alias("pattern"))
    longest = F.array_sort(F.transform("pattern", lambda p: F.struct((-F.length(p)).alias("n"), p.alias("pair"))))
    missed = F.floor(F.size("pattern") * (1 - dice / (2 - dice)) + 1e-9).cast("int")
    t = t.withColumn("rare", F.transform(F.slice(longest, F.lit(1), missed + 1), lambda r: r["pair"]))
    return t.select("license", "pattern", "n_words", "rare", F.posexplode("pairs").alias("place", "anchor")).where(F.array_contains("rare", F.col("anchor"))).drop("rare")


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Windows of documents that match a license template.

    Returns doc_id, first_word, n_words (of the window), license, dice (rounded to 6 places): of windows that begin
    within SLACK words of each other the best, on a tie the first license by name, then the first window.

    * Words are runs of letters and digits in lower case, over line ends; bigrams of a window are counted once.
    * A window is placed by an anchor of its template at the anchor's own place, and cut at the document's ends.
    * Null, empty and blank texts, and those of one word, match nothing. A null doc_id is reported as null.
    * Texts of any length are scanned whole. Rows that repeat a doc_id are one document whose windows overlay.
      An empty table gives an empty result. Other columns are not looked at.
    """
    anchors = _anchors(docs.sparkSession, templates, dice)
    words, at = F.col("words"), F.col("at")
    cut = docs.select("doc_id", _words(F.lower(text_of())).alias("words")).where(F.size("words") > 1)
    places = cut.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("at"))
    places = places.withColumn("anchor", F.concat_ws(" ", F.get(words, at), F.get(words, at + 1)))
    met = places.join(checked_broadcast(anchors, anchors.count(), BROADCAST_ANCHORS), "anchor")
    first = F.greatest(at - F.col("place"), F.lit(0))
    window = F.slice(words, first + 1, at - F.col("place") + F.col("n_words") - first)
    # written before anything else is done with it: windows alone leave the join, not a copy of the document for each position
    met = table(met.select("doc_id", first.alias("first_word"), "license", "pattern", window.alias("window")), "license-windows")
    met = met.select("doc_id", "first_word", "license", "pattern", F.size("window").alias("n_words"), F.array_distinct(_pairs(F.col("window"))).alias("bigrams"))
    size, goal = F.size("bigrams"), F.size("pattern")
    met = met.where(size.between(goal * (dice / (2 - dice)) - 1e-9, goal * ((2 - dice) / dice) + 1e-9))
    met = met.withColumn("dice", 2 * F.size(F.array_intersect("bigrams", "pattern")) / (size + goal)).where(F.col("dice") >= dice)
    best = met.groupBy("doc_id", "first_word").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license", "n_words")).alias("best"))
    best = best.select("doc_id", "first_word", F.struct(F.col("best.d").alias("d"), F.col("best.license").alias("license"), F.col("first_word").alias("at"), F.col("best.n_words").alias("n_words")).alias("own"))
    near = Window.partitionBy("doc_id").orderBy("first_word").rangeBetween(-SLACK, SLACK)
    best = best.withColumn("least", F.min("own").over(near)).where("own = least")
    return best.select("doc_id", "first_word", F.col("own.n_words").alias("n_words"), F.col("own.license").alias("license"), F.round(-F.col("own.d"), 6).alias("dice"))


def sql(templates: dict[str, list[str]] = TEMPLATES, dice: float = DICE) -> str:
    """The scan in DuckDB SQL."""
    values = ", ".join(f"('{name}', {i}, '{text.replace(chr(39), chr(39) * 2)}')" for name, texts in templates.items() for i, text in enumerate(texts))
    words = r"list_filter(string_split_regex({}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    low, high = dice / (2 - dice), (2 - dice) / dice
    return f"""
WITH t0(license, template_no, notice) AS (VALUES {values}),
t1 AS (SELECT license, template_no, {words.format("lower(notice)")} AS words FROM t0),
t AS (SELECT license, template_no, len(words) AS n_words, {pairs.format("words")} AS pairs, list_distinct({pairs.format("words")}) AS pattern FROM t1 WHERE len(words) > 1),
p AS (SELECT license, template_no, unnest(pattern) AS pair FROM t),
r AS (SELECT p.license, p.template_no, pair FROM p JOIN t ON t.license = p.license AND t.template_no = p.template_no
  QUALIFY row_number() OVER (PARTITION BY p.license, p.template_no ORDER BY length(pair) DESC, pair) <= floor(len(pattern) * {1 - low} + 1e-9) + 1),
a0 AS (SELECT license, template_no, n_words, pattern, unnest(pairs) AS anchor, generate_subscripts(pairs, 1) - 1 AS place FROM t),
a AS (SELECT a0.* FROM a0 JOIN r ON r.license = a0.license AND r.template_no = a0.template_no AND r.pair = a0.anchor),
d AS (SELECT doc_id, {words.format("lower(text)")} AS words FROM documents),
k AS (SELECT doc_id, words, unnest(range(0, len(words) - 1)) AS pos FROM d WHERE len(words) > 1),
h AS (SELECT doc_id, greatest(pos - place, 0) AS first_word, license, pattern, words[greatest(pos - place, 0) + 1 : pos - place + n_words] AS win FROM k JOIN a ON a.anchor = words[pos + 1] || ' ' || words[pos + 2]),
b AS (SELECT doc_id, first_word, license, pattern, len(win) AS n_words, list_distinct({pairs.format("win")}) AS bigrams FROM h),
m AS (SELECT doc_id, first_word, license, n_words, 2.0E0 * len(list_intersect(bigrams, pattern)) / (len(bigrams) + len(pattern)) AS dice FROM b
  WHERE len(bigrams) BETWEEN len(pattern) * {low} - 1e-9 AND len(pattern) * {high} + 1e-9),
f AS (SELECT doc_id, first_word, min(struct_pack(d := -dice, license := license, at := first_word, n_words := n_words)) AS own FROM m WHERE dice >= {dice} GROUP BY doc_id, first_word),
n AS (SELECT doc_id, first_word, own, min(own) OVER (PARTITION BY doc_id ORDER BY first_word RANGE BETWEEN {SLACK} PRECEDING AND {SLACK} FOLLOWING) AS least FROM f)
SELECT doc_id, CAST(first_word AS INT) AS first_word, CAST(own.n_words AS INT) AS n_words, own.license AS license, round(-own.d, 6) AS dice FROM n WHERE own = least
"""

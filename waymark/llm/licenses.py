"""License scan: Dice coefficient over word bigrams against licence templates.

A document's units are its lines, its paragraphs (between blank lines) and the
whole text.  Units and templates are normalised (lower case, runs of other
characters than letters and digits become one space) and compared as sets of
word bigrams: ``2 * common / (n + m)``.  That can reach the threshold ``t`` only
if ``n`` lies between ``t / (2 - t) * m`` and its inverse, so a template is a
candidate only for units of such sizes, and a unit that fits no template is
dropped before any bigram is made.

Null and empty texts have no licence.  Rows that repeat an id are judged
together and each gets the result.  Ties go to the template listed first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Licence notices and texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
)


def bigrams_of(text: str) -> set[str]:
    """The word bigrams of one normalised text."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """The numbers of bigrams that a unit may have to reach the threshold against a template of ``size``."""
    return threshold / (2 - threshold) * size, (2 - threshold) / threshold * size


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: ``id_col, license`` (null: none), ``dice`` (null: none) and ``n_units`` that carry a licence."""
    sets = [(name, sorted(bigrams_of(text))) for name, text in templates]
    spans = [bounds(len(s), threshold) for _, s in sets]
    low, high = min(a for a, _ in spans), max(b for _, b in spans)
    # a column that Spark takes for non-deterministic is computed once per row; else filters on it are pushed below it and repeat it
    once = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    text = F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9\n]+", " ")
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), once(text).alias("__text"))
    parts = F.when(F.col("__text").rlike(r"\n ?\n"), F.split("__text", r"\n(?: ?\n)+")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.transform(F.concat(F.split("__text", "\n"), parts, F.array("__text")), lambda u: F.trim(F.replace(u, F.lit("\n"), F.lit(" ")))))
    rows = rows.select("__id", F.explode(once(units)).alias("__unit"))
    # n bigrams take n + 1 words and so 2n + 1 characters at least; n is at least the number of distinct words less one
    rows = rows.where(F.length("__unit") >= 2 * low + 1).select("__id", once(F.split("__unit", " +")).alias("__words"))
    # a unit of n bigrams reaches the threshold only with t / (2 - t) * n bigrams of a template, and so as many of its words
    listed = ", ".join(f"'{w}'" for w in sorted({w for _, pairs in sets for pair in pairs for w in pair.split(" ")}))
    known = F.expr(f"size(filter(__words, w -> w in ({listed})))")
    rows = rows.select("__id", "__words", once(known).alias("__known")).where(F.col("__known") >= 1 + low)
    share = threshold / (2 - threshold)
    distinct = F.size(F.array_distinct("__words"))
    rows = rows.select("__id", "__words", "__known", once(distinct).alias("__distinct")).where((F.col("__distinct") <= high + 1) & (F.col("__known") >= share * (F.col("__distinct") - 1)))
    pairs = F.expr("array_distinct(zip_with(slice(__words, 1, size(__words) - 1), slice(__words, 2, size(__words) - 1), (a, b) -> concat(a, ' ', b)))")
    rows = rows.select("__id", once(pairs).alias("__pairs")).where(F.size("__pairs").between(low, high))
    best = F.lit(None).cast("struct<dice:double,at:int>")
    for at, ((_, wanted), (least, most)) in enumerate(zip(sets, spans)):
        common = F.size(F.array_intersect("__pairs", F.array(*map(F.lit, wanted))))
        dice = 2.0 * common / (F.size("__pairs") + len(wanted))
        mark = F.when(F.size("__pairs").between(least, most), F.struct(dice.alias("dice"), F.lit(-at).alias("at")))
        best = mark if at == 0 else F.greatest(best, mark)
    found = rows.select("__id", once(best).alias("__best")).where(F.col("__best.dice") >= threshold)
    found = found.groupBy("__id").agg(F.max("__best").alias("__best"), F.count(F.lit(1)).alias("__n"))
    name = F.element_at(F.array(*(F.lit(n) for n, _ in sets)), 1 - F.col("__best.at"))
    found = found.select("__id", name.alias("license"), F.round("__best.dice", 6).alias("dice"), F.col("__n").alias("n_units"))
    return df.select(id_col).join(found, F.col(id_col).eqNullSafe(F.col("__id")), "left").select(id_col, "license", "dice", F.coalesce("n_units", F.lit(0)).cast("bigint").alias("n_units"))

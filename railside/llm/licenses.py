"""License notices by MinHash bands over overlapping text windows, with DataFrame functions only.

Windows are a quarter longer than a template in shingles and start at every eighth of it. Of a
window those shingles count that stand in some template at all; their MinHash values form BANDS
bands of ROWS. A window that holds a template at the least containment and stands among other
notices has a Jaccard similarity above 0.55 with it, and shares a band with probability above
1 - (1 - 0.55**2)**24 > 0.9998; among other words the similarity is that of the shingles found, at
least the containment. Equal sets of shingles are banded once, however many windows have them.

A template that a band retrieves for a document is verified there exactly. A template's shingle at
place t that stands at position p of the document lies on the diagonal p - t. An occurrence is a base
b such that enough of the template's shingles stand on diagonals from b to b + m / 2, m being the
template's number of shingles: in their order, with up to half its length put in between. Bases of
two occurrences are more than m / 2 apart, and are taken from the left; a notice that follows
another at once lies a whole length further, so parts of the two never make a third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railside.llm.cluster import cut, missing, small_side

BANDS, ROWS = 24, 2
#: Share of a template's shingles that must be present.
CONTAINMENT = 0.8
WORDS = 5

# Notices of public licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": ["under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}


def word_array(text: Column) -> Column:
    """Runs of ASCII letters and digits, lowered."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def with_shingles(df: DataFrame, text: Column, k: int = WORDS) -> DataFrame:
    """Adds ``words`` and ``shingles``: the hash of the k words from each position, in order.

    A text of fewer words, but not none, has one shingle. Hashes of longer runs are put together
    from those of shorter ones, an array at a time.
    """

    def shifted(name: str, by: int) -> Column:
        return F.slice(F.col(name), F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))

    def joined(a: Column, b: Column) -> Column:
        return F.filter(F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y))), lambda h: h.isNotNull())

    df = df.withColumn("words", word_array(text))
    df = df.withColumn("_run", F.transform("words", lambda w: F.xxhash64(w)))
    one = "_run"
    df = df.withColumn("_one", F.col(one))
    for i in range(1, k):
        df = df.withColumn("_run", joined(F.col("_run"), shifted("_one", i)))
    short = F.when(F.size("words") > 0, F.array(F.xxhash64("words"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("shingles", F.when(F.size("words") >= k, F.col("_run")).otherwise(short)).drop("_run", "_one")


def template_table(spark: SparkSession, templates: dict[str, list[str]] | DataFrame | None = None, k: int = WORDS) -> DataFrame:
    """license, template_no, places (the shingle at each), shingles (distinct), m: how many.

    The templates are given, not data: texts by license, or a table with columns license and text,
    whose texts are numbered in their order within a license.
    """
    if isinstance(templates, DataFrame):
        numbered = templates.select("license", "text").where("license is not null").distinct()
        texts = numbered.withColumn("template_no", F.row_number().over(Window.partitionBy("license").orderBy("text")) - 1)
    else:
        rows = [(name, i, t) for name, texts in (templates or TEMPLATES).items() for i, t in enumerate(texts)]
        texts = spark.createDataFrame(rows, "license string, template_no int, text string")
    table = with_shingles(texts, F.col("text"), k)
    return cut(table.select("license", "template_no", F.col("shingles").alias("places"), F.array_distinct("shingles").alias("shingles")).withColumn("m", F.size("shingles")).where("m > 0"))


def _windows(m: int) -> Column:
    """(m, start) of the windows for templates of m shingles that hold one of the positions ``at``."""
    step, length = max(1, m // 8), m + m // 4
    spans = F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - length + 1) / step).cast("int")), F.floor(p / step).cast("int")))
    return F.transform(F.array_distinct(F.flatten(spans)), lambda n: F.struct(F.lit(m).alias("m"), (n * step).alias("start")))


def _bands(shingles: Column) -> Column:
    """Band keys of a set of shingles."""

    def least(j: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(j))))

    minima = [[least(b * ROWS + r) for r in range(ROWS)] for b in range(BANDS)]
    return F.array(*[F.xxhash64(F.lit(b), *row) for b, row in enumerate(minima)])


def _retrieved(some: DataFrame, known: DataFrame) -> DataFrame:
    """(row, license, template_no) of templates that share a band with a window of the row."""
    numbered = [_windows(r["m"]) for r in known.select("m").distinct().orderBy("m").collect()]
    if not numbered:
        return some.select("row", F.lit("").alias("license"), F.lit(0).alias("template_no")).limit(0)
    windows = some.select("row", "shingles", "hits", F.explode(F.concat(*numbered)).alias("w"))
    inside = F.slice("shingles", F.col("w.start") + 1, F.col("w.m") + F.floor(F.col("w.m") / 4).cast("int"))
    sets = windows.select("row", "w.m", F.sort_array(F.array_intersect("hits", inside)).alias("set"))
    # a window with fewer shingles of any template cannot reach the similarity that bands are set for
    sets = sets.where(F.size("set") >= 0.55 * F.col("m")).withColumn("key", F.xxhash64("set"))
    sets = cut(sets.select("row", "m", "key", "set"))
    banded = small_side(cut(known.select("license", "template_no", "m", F.explode(_bands(F.col("shingles"))).alias("band"))))
    different = sets.groupBy("m", "key").agg(F.first("set").alias("set"))
    found = different.select("m", "key", F.explode(_bands(F.col("set"))).alias("band")).join(banded, ["m", "band"]).select("m", "key", "license", "template_no").distinct()
    return sets.select("row", "m", "key").distinct().join(small_side(cut(found)), ["m", "key"]).select("row", "license", "template_no").distinct()


def _occurrences(some: DataFrame, known: DataFrame, candidates: DataFrame, containment: float) -> DataFrame:
    """(row, license, template_no, start) of all occurrences of the candidates' templates in their rows."""
    of, half = ["row", "license", "template_no"], F.floor(F.col("m") / 2).cast("int")
    places = small_side(cut(known.select("license", "template_no", "m", F.posexplode("places").alias("t", "s"))))
    hits = some.select("row", F.explode(F.transform("at", lambda p: F.struct(p.alias("p"), F.element_at("shingles", p + 1).alias("s")))).alias("h")).select("row", "h.p", "h.s")
    hits = hits.join(places, "s").join(small_side(cut(candidates)), of).select(*of, "m", "s", "p", (F.col("p") - F.col("t")).alias("d"))
    # cells of diagonals: every band of half a length lies within two cells that follow one another
    cell = F.floor(F.col("d") / (half + 1)).cast("int")
    hits = cut(hits.select("*", cell.alias("own"), F.explode(F.array(cell - 1, cell)).alias("cell")))
    enough = F.lit(containment) * F.col("m")
    full = hits.groupBy(*of, "m", "cell").agg(F.size(F.collect_set("s")).alias("n")).where(F.col("n") >= enough)
    near = cut(hits.join(full.select(*of, "cell"), [*of, "cell"]))
    bases = near.where(F.col("own") == F.col("cell")).select(*of, "cell", F.col("d").alias("base")).distinct()
    banded = near.join(bases, [*of, "cell"]).where(F.col("d").between(F.col("base"), F.col("base") + half))
    found = banded.groupBy(*of, "m", "base").agg(F.size(F.collect_set("s")).alias("n"), F.min("p").alias("start")).where(F.col("n") >= enough)
    none = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("starts"))

    def take(acc: Column, at: Column) -> Column:
        free = acc["last"].isNull() | (at["base"] > acc["last"] + half)
        return F.when(free, F.struct(at["base"].alias("last"), F.concat(acc["starts"], F.array(at["start"])).alias("starts"))).otherwise(acc)

    found = found.groupBy(*of, "m").agg(F.sort_array(F.collect_list(F.struct("base", F.col("start").cast("int").alias("start")))).alias("bases"))
    return found.select(*of, F.explode(F.aggregate("bases", none, take)["starts"]).alias("start"))


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, k: int = WORDS) -> DataFrame:
    """One row per document row: id, n_matches, licenses, matches.

    ``licenses`` joins the identifiers found, sorted, by commas; ``matches`` names each occurrence of a
    template (see above) as identifier:template:position of its first shingle that is there. Words are
    runs of ASCII letters and digits, lowered; shingles have ``k`` words, and ``containment`` of a
    template's must be there. Null and empty texts match nothing; repeated rows match alike; an empty
    table gives no rows; without templates nothing matches; other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates, k)
    held = [r["s"] for r in known.select(F.explode("shingles").alias("s")).distinct().collect()]  # the given templates'
    every = F.array(*[F.lit(s) for s in held]).cast("array<bigint>")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), missing(F.col(text_col).cast("string"), "").alias("text"))
    rows = cut(with_shingles(rows, F.col("text"), k).select("id", "row", "shingles", F.array_intersect("shingles", every).alias("hits")).select("id", "row", "hits", F.when(F.size("hits") > 0, F.col("shingles")).alias("shingles")))
    at = F.filter(F.transform("shingles", lambda s, i: F.when(F.array_contains("hits", s), i)), lambda i: i.isNotNull())
    some = rows.where(F.size("hits") > 0).select("row", "shingles", "hits", at.alias("at"))
    found = _occurrences(some, known, _retrieved(some, known), containment)
    found = found.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "license", "template_no", "start"))), ",").alias("matches"))
    found = small_side(cut(found.withColumnRenamed("row", "own")))
    out = rows.select("id", "row").join(found, F.col("row") == F.col("own"), "left")
    return out.select(F.col("id").alias(id_col), missing(F.col("n"), 0).cast("long").alias("n_matches"), missing(F.col("licenses"), "").alias("licenses"), missing(F.col("matches"), "").alias("matches"))

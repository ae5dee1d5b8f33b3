"""License scans: sparse TF-IDF cosine of headers and license files to templates, and inheritance by directory.

What may state a license, in a text that speaks of rights anywhere, is each line that does, each paragraph
that does, all from the first to the last such paragraph (a header of several paragraphs), and the whole text
(a license file). Distinct statements are weighted by inverse document frequencies counted over all statements
of the table, and compared with the templates, which are short notices and full public license texts, over
the words they share. The license of the nearest template over all of a text's statements is the text's own.
A document without one takes that of the nearest directory above it, or its own, that has a license file.
Directories are resolved once each, not once a document, so a directory with very many documents is no
heavier than another; equal texts are judged once.

A null text states nothing; a null path has no directory, but its text is judged. Ties go to the template,
and among a directory's license files to the path, that sorts first. Repeated rows each get the result, also
where rows share a path. Empty tables give no rows. Only path and text are read, and all columns of the input
are returned, whatever their names; the added ones replace columns of the same names.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name
from .components import stored

#: Short notices and titles by which works declare public licenses. Full texts are in license_texts.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
TRIGGER = r"(?i)licen[cs]e|copyright|public domain|redistribution|permission is hereby"
#: Between paragraphs.
GAP = r"\n[ \t\r\n]*\n"
THRESHOLD = 0.6
_LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.].*)?$"


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """License and text of the notices, and of the full texts that come with this library."""
    full = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return tuple(NOTICES + full)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _template_words(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> DataFrame:
    """template (a number), license, word and tf."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(_words(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))


def statements(text: Column) -> Column:
    """What may state a license in a text."""
    speaks = lambda x: x.rlike(TRIGGER)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), speaks)
    paragraphs = F.split(text, GAP)
    marks = F.transform(paragraphs, speaks)
    first, after = F.array_position(marks, True).cast("int"), F.array_position(F.reverse(marks), True).cast("int")
    header = F.array_join(F.slice(paragraphs, first, F.size(marks) - first - after + 2), "\n\n")
    whole = F.array(F.when((first > 0) & (after > 0), header), text)
    return F.filter(F.array_distinct(F.concat(lines, F.filter(paragraphs, speaks), whole)), lambda x: x.isNotNull())


def judged_texts(texts: DataFrame, threshold: float = THRESHOLD, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """key (a hash of the text), license and score of the rows of texts(text) with a statement that comes near enough to a
    template, a row for each distinct text. Statements are known by hashes of 128 bits; of a text, only the counts of its words
    are written, once for all its copies."""
    spark = texts.sparkSession
    said = texts.select(F.sha2("text", 256).alias("key"), F.explode(statements(F.col("text"))).alias("said"))
    said = said.select("key", F.unhex(F.md5("said")).alias("id"), "said")
    # each row of a statement counts its words and, once for each text, the empty word: that is how often the statement stands
    words = said.select("key", "id", F.explode(F.array_append(_words(F.col("said")), F.lit(""))).alias("word"))
    words = stored(words.groupBy("id", "word", F.when(F.col("word") == "", F.col("key")).alias("key")).agg(F.count("*").alias("c")))
    of = words.where("word = ''").select("key", "id", "c")
    times = of.groupBy("id").agg(F.sum("c").alias("n"))
    total = times.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    words = words.where("word != ''").join(times, "id").select("id", "n", "word", F.expr("c div n").alias("tf"))
    rarity = words.groupBy("word").agg(F.sum("n").alias("df"))
    idf = lambda df: F.log((F.col("total") + 1) / (df + 1)) + 1
    weighted = words.join(rarity, "word").join(F.broadcast(total)).select("id", "word", (F.col("tf") * idf(F.col("df"))).alias("w"))  # total: one row
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    terms = _template_words(spark, known or templates()).join(rarity, "word", "left").join(F.broadcast(total))
    terms = stored(terms.select("template", "license", "word", (F.col("tf") * idf(F.coalesce("df", F.lit(0)))).alias("tw")))
    sizes = terms.groupBy("template", "license").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("size"))
    # terms: the words of the templates, which are a fixed list
    dots = weighted.join(F.broadcast(terms.drop("license")), "word").groupBy("id", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "id").join(F.broadcast(sizes), "template").select("id", "license", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("score"))
    near = scored.where(F.col("score") >= threshold).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    best = of.select("key", "id").join(near, "id").groupBy("key").agg(F.min("b").alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """docs(path, text, ...) with license, license_score and license_via ("own", "directory" or "none"). known: the templates,
    as (license, text); if None, those of `templates`."""
    docs = docs.drop("license", "license_score", "license_via")
    key_of = F.when(F.col("text").rlike(TRIGGER), F.sha2(F.col("text"), 256))
    own = stored(judged_texts(docs.select("text").where(F.col("text").rlike(TRIGGER)), threshold, known))
    files = docs.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(_LICENSE_FILE)).select("path", key_of.alias("key")).join(own, "key")
    order = F.struct("path", (-F.col("score")).alias("s"), "license")
    per_dir = files.groupBy(directory_of(F.col("path")).alias("at")).agg(F.min_by(F.struct("license", "score"), order).alias("f"))
    dirs = docs.where(F.col("path").isNotNull()).select(directory_of(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("at"))
    near = above.join(per_dir, "at").groupBy("dir").agg(F.max_by("f", F.length("at")).alias("f"))
    taken = list(docs.columns)
    key, dir_, mine, theirs = names = [free_name(n, taken + ["license", "license_score", "license_via"]) for n in ("key", "dir", "mine", "theirs")]
    # rows without a key or a directory would all meet in one task; no key starts with a line break, and no directory holds one
    none = F.concat(F.lit("\n"), F.xxhash64("path", "text").cast("string"))
    joined = docs.withColumns({key: F.coalesce(key_of, none), dir_: F.coalesce(directory_of(F.col("path")), none)})
    joined = joined.join(own.select(F.col("key").alias(key), F.struct("license", "score").alias(mine)), key, "left")
    joined = joined.join(near.select(F.col("dir").alias(dir_), F.col("f").alias(theirs)), dir_, "left")
    via = F.when(F.col(mine).isNotNull(), "own").when(F.col(theirs).isNotNull(), "directory").otherwise("none")
    found = F.coalesce(mine, theirs)
    return joined.withColumns({"license": found["license"], "license_score": found["score"], "license_via": via}).drop(*names).select(*taken, "license", "license_score", "license_via")

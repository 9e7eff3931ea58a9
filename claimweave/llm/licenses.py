"""Licence scans: TF-IDF cosine of lines to licence templates, inherited along directories.

Every line of a file is a sparse vector: a term (lower-case run of letters and digits) weighs 1 + ln(count) times
1 + ln((1 + templates) / (1 + templates with the term)), as if no template had it if none has, and as if
all had it if it is a common word. Templates are vectors alike. A line states the licence of the nearest template if
their cosine reaches `SIMILARITY` and they share `LEAST_SHARED` terms; a file has the licence of its best line. Each template has anchors: its
heaviest terms, as many as needed for the others alone to stay below the threshold. So a line without an
anchor cannot reach it. Nor can a line whose other words outweigh those it has in common with all templates; what
is left after these two exact tests, mostly statements, is cut into terms and compared. Templates are a parameter and their table is
broadcast only if it is small.

A file is a licence file of its directory if its name says so, or if lines that state its licence hold at
least `COVERAGE` of its terms. Files without a licence of their own get that of the nearest directory
upwards that has a licence file. Directories, not files, are joined with their ancestors, so a
directory of a third of all files costs one row.

Defined results: null and empty texts state nothing, but inherit. A null path has no directory and inherits nothing.
Of several licence files of a directory the greatest cosine counts, then the lesser name. Ties
between templates go to the lesser name, between lines to the earlier. Repeated rows get
equal results. Without templates nothing is found; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import KEY, let, small, text_key, tokens, written

SIMILARITY = 0.6
# A line states a licence only if it shares so many different terms with the template.
LEAST_SHARED = 3
# Terms that any text may have; they, and terms of one character, weigh as if all templates had them.
COMMON = frozenset(
    "all an and any as at be been by can for from has have in into is it its may no not of on or other such that the "
    "their this to under was were which will with you your".split())
COVERAGE = 0.5
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|unlicense|notice)s?([._-][^/]*)?$"
#: Headers and statements by which files name their licence.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-2-Clause", "Released under the 2-clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work: CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


class Templates:
    """Vectors of templates, the weight of terms, and the anchors."""

    def __init__(self, texts: tuple[tuple[str, str], ...] = TEMPLATES, similarity: float = SIMILARITY):
        counts = [(name, Counter(re.findall(r"[^\W_]+", text.lower()))) for name, text in texts]
        df = Counter(t for _, c in counts for t in c)
        self.unknown = 1 + math.log(1 + len(counts))
        for t in COMMON | set(t for t in df if len(t) == 1):
            df[t] = len(counts)
        self.idf = {t: 1 + math.log((1 + len(counts)) / (1 + n)) for t, n in df.items()}
        self.similarity = similarity
        self.entries: list[tuple[int, str, str, float]] = []
        anchors: set[str] = set()
        for i, (name, c) in enumerate(counts):
            weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.entries += [(i, name, t, w / norm) for t, w in sorted(weights.items())]
            rest = 1.0
            for t in sorted(weights, key=lambda t: (-weights[t], t)):
                if rest < (similarity * 0.999) ** 2:
                    break
                anchors.add(t)
                rest -= (weights[t] / norm) ** 2
        self.anchors = sorted(anchors)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, "template int, license string, term string, weight double")


def _anchored(terms: Column, anchors: list[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, anchors))) if anchors else F.lit(False)


def _could_state(terms: Column, templates: Templates) -> Column:
    """Whether a line's terms leave room for the threshold, by the terms that it has in common with any template.

    The cosine is at most the length of the line's vector on these terms over its whole length, and
    every other term adds at least the weight of an unknown one to the latter.
    """
    if not templates.idf:
        return F.lit(False)
    known = F.array_intersect(terms, F.array(*map(F.lit, sorted(templates.idf))))
    idf = F.create_map(*(F.lit(x) for pair in sorted(templates.idf.items()) for x in pair))

    def added(total: Column, term: Column) -> Column:
        weight = (1 + F.log(F.size(F.filter(terms, lambda x: x == term)))) * F.element_at(idf, term)
        return total + weight * weight

    others = F.size(F.array_distinct(terms)) - F.size(known)
    least = F.lit(0.999 * templates.similarity**2)
    enough = let(F.aggregate(known, F.lit(0.0), added),
                 lambda v: v >= least * (v + others * F.lit(templates.unknown**2)))
    return (F.size(known) >= LEAST_SHARED) & enough


def statements(files: DataFrame, templates: Templates, text: str = "text") -> DataFrame:
    """(key1, key2, license, similarity, line, covered) of distinct texts that state a licence.

    covered: the share of the text's terms in lines that state it.
    """
    spark = files.sparkSession
    body = F.col(text).cast("string")
    texts = files.select(body.alias("body")).where(_anchored(tokens(F.col("body")), templates.anchors))
    lines = texts.select(*text_key(F.col("body")), F.size(tokens(F.col("body"))).alias("terms"),
                         F.posexplode(F.split("body", "\n")).alias("line", "of"))
    # Copies of a text give equal lines, of which one is needed.
    of = tokens(F.col("of"))
    lines = lines.where(_anchored(of, templates.anchors)).where(let(of, lambda t: _could_state(t, templates)))
    lines = lines.dropDuplicates([*KEY, "line"])
    lines = written(lines, "licence_lines")
    at = [*KEY, "line"]
    counts = lines.select(*at, F.explode(tokens(F.col("of"))).alias("term")).groupBy(*at, "term").agg(F.count("*").alias("n"))
    entries = templates.frame(spark)
    idf = spark.createDataFrame(sorted(templates.idf.items()), "term string, idf double")
    weighed = counts.join(small(idf, 48), "term", "left").withColumn(
        "w", (1 + F.log(F.col("n"))) * F.coalesce("idf", F.lit(templates.unknown)))
    norms = weighed.groupBy(*at).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("n"))
    dots = weighed.join(small(entries, 64), "term").groupBy(*at, "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count("*").alias("shared"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    near = dots.join(norms, at).withColumn("similarity", cosine).where(
        (F.col("similarity") >= templates.similarity) & (F.col("shared") >= LEAST_SHARED))
    # The greatest cosine; of equal ones the lesser name.
    best = near.groupBy(*at).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license", "n")).alias("b"))
    best = best.select(*at, (-F.col("b.s")).alias("similarity"), F.col("b.license").alias("license"), F.col("b.n").alias("n"))
    sizes = lines.groupBy(*KEY).agg(F.max("terms").alias("terms"))
    of_text = best.groupBy(*KEY).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "line", "license")).alias("b"),
        F.collect_list(F.struct("license", "n")).alias("all"))
    said = F.aggregate(F.filter("all", lambda x: x["license"] == F.col("b.license")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return of_text.join(sizes, KEY).select(
        *KEY, F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"), F.col("b.line").alias("line"),
        (said / F.col("terms")).alias("covered"))


def parent(path: Column) -> Column:
    """Directory of a path: what precedes its last slash, the empty root if there is none."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, as (depth, directory); depth 0 is the root."""
    names = F.filter(F.split(directory, "/"), lambda x: x != "")
    steps = F.sequence(F.lit(0), F.size(names))
    return F.transform(steps, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(names, 1, d), "/").alias("above")))


def scan(files: DataFrame, path: str | Column = "path", text: str = "text", id_column: str | None = None,
         templates: Templates | None = None) -> DataFrame:
    """(path, license, origin, similarity, licence_file, from_directory), and the id column if named.

    origin: own, inherited, or null if no licence is known.
    """
    templates = templates or Templates()
    body = F.col(text).cast("string")
    where = (F.col(path) if isinstance(path, str) else path).cast("string")
    found = small(written(statements(files.select(body.alias("text")), templates), "statements"), 64)
    ids = [F.col(id_column).alias("id")] if id_column else []
    rows = files.select(*ids, where.alias("path"), *text_key(body)).join(found, KEY, "left").withColumn(
        "directory", parent(F.col("path")))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    rows = rows.withColumn("licence_file", F.col("license").isNotNull() & (named | (F.col("covered") >= COVERAGE)))
    rows = written(rows.drop(*KEY, "line", "covered"), "files")
    # Of each directory the best licence file, then of each directory of files the nearest above.
    given = rows.where("licence_file AND directory IS NOT NULL").groupBy("directory").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select(
        F.array_join(F.filter(F.split("directory", "/"), lambda x: x != ""), "/").alias("above"), F.col("b").alias("given"))
    given = given.groupBy("above").agg(F.min("given").alias("given"))
    places = rows.where("license IS NULL AND directory IS NOT NULL").select("directory").distinct()
    above = places.select("directory", F.inline(ancestors(F.col("directory"))))
    nearest = above.join(given, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "given")).alias("a"))
    nearest = nearest.select(F.col("directory").alias("place"), F.col("a.above").alias("from_directory"), "a.given")
    joined = rows.join(small(written(nearest, "inherited"), 128), F.col("license").isNull() & (F.col("directory") == F.col("place")), "left")
    license = F.coalesce("license", "given.license")
    out = joined.select(
        *([F.col("id").alias(id_column)] if id_column else []), "path", license.alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(license.isNotNull(), "inherited").alias("origin"),
        F.coalesce("similarity", -F.col("given.s")).alias("similarity"), "licence_file", "from_directory")
    return out

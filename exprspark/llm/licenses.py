"""Licence scan in DataFrame operations only: sparse TF-IDF cosine of lines to licence templates, then inheritance
from the nearest ancestor directory that has a licence.

Header candidates are every line of a file, every run of words of a template's length that begins with one of its
words, across line ends too, and a licence file as a whole. A candidate can reach the threshold only if it holds an
anchor term of some template: terms are taken heaviest first until the rest of the template weighs too little; texts
without anchors are dropped before any words are exploded, and nothing is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprspark.session import cut

THRESHOLD = 0.6
#: Identifying lines of licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
]
#: Names of files that license their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-].*)?$"
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def terms(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, joined by single dots and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def frequencies(files: DataFrame) -> DataFrame:
    """(term, df): the number of files that hold each term, of all terms of all files."""
    return cut(files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def weights(files: DataFrame, templates: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, list[str], int]:
    """(template terms with weight, template norms and lengths, anchor terms, number of files).

    idf = ln((files + 1) / (files that hold the term + 1)) + 1, over all files.
    """
    vocabulary = sorted({w for r in templates.select(terms(F.col("text")).alias("t")).collect() for w in r["t"]})  # the templates' own size
    found = {r["term"]: r["df"] for r in held.where(F.col("term").isin(vocabulary)).collect()}  # at most the vocabulary
    total = files.count()
    idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}
    sizes = {r["template"]: r["n"] for r in templates.select("template", F.size(terms(F.col("text"))).alias("n")).collect()}
    rows = [(r["template"], r["license"], w, r["t"].count(w) * idf[w]) for r in templates.select("template", "license", terms(F.col("text")).alias("t")).collect() for w in sorted(set(r["t"]))]
    anchors: set[str] = set()
    norms = {}
    for t in {r[0] for r in rows}:
        own = sorted(((w, x) for k, _, w, x in rows if k == t), key=lambda p: (-p[1], p[0]))
        norms[t] = math.sqrt(math.fsum(x * x for _, x in own))
        rest = math.fsum(x * x for _, x in own)
        for w, x in own:
            if rest < (THRESHOLD * norms[t]) ** 2 * (1 - 1e-9):
                break
            anchors.add(w)
            rest -= x * x
    spark = files.sparkSession
    side = spark.createDataFrame([(t, n, w, x, idf[w]) for t, n, w, x in rows] or [("", "", "", 0.0, 0.0)], "template string, license string, term string, weight double, idf double")
    return side, spark.createDataFrame([(t, n, sizes[t]) for t, n in norms.items()] or [("", 1.0, 1)], "template string, norm double, n int"), sorted(anchors), total


def _passages(texts: DataFrame, side: DataFrame, norms: DataFrame) -> DataFrame:
    """(path, line, only): the runs of words that may reach the threshold of a template `only`.

    A run of n words lies in two neighbouring blocks of n words of its text; where the template's terms found in these
    weigh too little, no run that begins in the first of them is formed.
    """
    placed = cut(texts.withColumn("id", F.xxhash64("path", "text")).select("id", "path", terms(F.col("text")).alias("w")).where("size(w) > 0").distinct())
    vocabulary = F.broadcast(side.select("template", "term", "weight"))
    hits = placed.select("id", F.posexplode("w").alias("pos", "term")).join(vocabulary, "term").join(F.broadcast(norms), "template").withColumn("block", F.floor(F.col("pos") / F.col("n")))
    hits = cut(hits.select("id", "template", "pos", "block", "term", "weight", "norm", "n"))
    near = hits.select("id", "template", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"), "term", "weight", "norm").distinct()
    enough = near.groupBy("id", "template", "block").agg(F.sum(F.col("weight") * F.col("weight")).alias("most"), F.first("norm").alias("norm")).where(
        F.col("most") >= THRESHOLD * THRESHOLD * F.col("norm") * F.col("norm") * (1 - 1e-9)).select("id", "template", "block")
    starts = hits.join(enough, ["id", "template", "block"]).select("id", "template", "pos", "n").distinct()
    return starts.join(placed, "id").select("path", F.array_join(F.expr("slice(w, pos + 1, n)"), " ").alias("line"), F.col("template").alias("only"))


def headers(files: DataFrame, templates: DataFrame) -> DataFrame:
    """(path, license, score): the best template of each file that has a line, a run of words or, in a licence file, a whole
    text with cosine `THRESHOLD` or more to one."""
    held = frequencies(files)
    side, norms, anchors, total = weights(files, templates, held)
    if not anchors:
        return files.sparkSession.createDataFrame([], "path string, license string, score double")
    some = F.array(*[F.lit(a) for a in anchors])
    texts = cut(files.where(F.arrays_overlap(terms(F.col("text")), some)).select("path", "text"))
    lines = texts.select("path", F.explode(F.split("text", "\n")).alias("line")).where(F.arrays_overlap(terms(F.col("line")), some))
    whole = texts.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE)).select("path", F.col("text").alias("line"))
    rows = lines.unionByName(whole).withColumn("only", F.lit("")).unionByName(_passages(texts, side, norms))
    keys = ["path", "only", "own"]  # a line's words carry its key, not the line
    words = rows.withColumn("own", F.xxhash64("line")).dropDuplicates(keys).select(*keys, F.explode(terms(F.col("line"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = F.broadcast(side.select("term", "idf").distinct())  # the templates' vocabulary
    outside = F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = cut(words.join(held, "term", "left").join(known, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", outside)).drop("df"))
    length = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = weighed.join(F.broadcast(side.select("template", "license", "term", "weight")), "term").where("only in ('', template)").groupBy(*keys, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(F.broadcast(norms), "template").join(length, keys).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6))
    ranked = scored.where(F.col("score") >= THRESHOLD).groupBy("path", "license").agg(F.max("score").alias("score"))
    top = ranked.groupBy("path").agg(F.max("score").alias("score"))
    return ranked.join(top, ["path", "score"]).groupBy("path", "score").agg(F.min("license").alias("license")).select("path", "license", "score")


def scan(files: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Per row of files (path, text, ...): all its columns, license, origin, score, license_dir.

    origin is `header` where a line of the file itself matches, else `inherited` where an ancestor directory holds a
    licence file that does; the nearest one counts, and within a directory the best score, then the smaller name. A null or
    empty text has no header but inherits; a null path neither has nor inherits. Rows with one path share the best header of
    its texts.
    """
    spark: SparkSession = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame([(f"{i:03d}", name, text) for i, (name, text) in enumerate(TEMPLATES)], "template string, license string, text string")
    own = cut(headers(files.select("path", "text"), templates))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    in_dir = own.where(name.rlike(LICENCE_FILE)).withColumn("dir", folder).groupBy("dir", "license").agg(F.max("score").alias("score"))
    best = in_dir.groupBy("dir").agg(F.max("score").alias("score"))
    licensed = in_dir.join(best, ["dir", "score"]).groupBy("dir").agg(F.min("license").alias("dir_license"))

    # each directory finds its nearest licensed ancestor once, however many files it holds
    dirs = files.where("path is not null").select(folder.alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    above = dirs.select("own_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).where("depth > 0 or own_dir = ''").select(
        "own_dir", "depth", F.concat_ws("/", F.slice("parts", 1, F.col("depth"))).alias("dir"))
    above = above.unionByName(dirs.where("own_dir <> ''").select("own_dir", F.lit(0).alias("depth"), F.lit("").alias("dir")))
    nearest = above.join(licensed, "dir").groupBy("own_dir").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("near"))

    def fresh(name: str) -> str:
        """A name that no column of files has."""
        while name.lower() in {c.lower() for c in files.columns}:
            name = f"_{name}"
        return name

    path, at, of, found, value, near = map(fresh, ("scan_path", "scan_at", "scan_of", "scan_license", "scan_score", "scan_near"))
    mine = own.select(F.col("path").alias(path), F.col("license").alias(found), F.col("score").alias(value))
    above = nearest.select(F.col("own_dir").alias(of), F.col("near").alias(near))
    joined = files.withColumn(at, folder).join(mine, F.col("path") == F.col(path), "left").join(above, F.col(at) == F.col(of), "left")
    origin = F.when(F.col(found).isNotNull(), "header").when(F.col(near).isNotNull(), "inherited")
    passed = [F.col(f"`{c}`") for c in files.columns if c not in ("license", "origin", "score", "license_dir")]
    return joined.select(*passed, F.coalesce(F.col(found), F.col(near)["dir_license"]).alias("license"), origin.alias("origin"), F.col(value).alias("score"),
                         F.when(F.col(found).isNull(), F.col(near)["dir"]).alias("license_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: single lines lie in their source's directory, up to five lines in a directory of the language
    below it, longer texts in a directory per thousand ids below that. A text whose first line speaks of a licence is that
    directory's licence file."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    part = F.when(breaks == 0, F.lit("")).when(breaks <= 4, F.concat("lang", F.lit("/"))).otherwise(F.concat("lang", F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/")))
    first = F.substring_index("text", "\n", 1)
    name = F.when(F.lower(first).contains("licen"), F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat("source", F.lit("/"), F.coalesce(part, F.lit("")), F.coalesce(name, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"), "text")

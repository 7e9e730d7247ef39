"""Licence scan by sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of every text is a possible header, and a text that holds such a line is compared
as a whole too.  Only lines with an anchor word are weighed: without one of a template's
anchors, its heaviest words, no cosine can reach the threshold, so nothing is missed.  All of
it is DataFrame work; the templates are a fixed, small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

THRESHOLD = 0.6

#: Files that hold a licence by their name, whichever of their lines states it.
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice|copyright)s?([._-][^/]*)?$"

# Short headers and opening sentences of public licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Licensed under the BSD 3-Clause License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Proprietary": ["All rights reserved"],
}


def pieces(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing, and perhaps an empty string at either end."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing, as an array."""
    return F.filter(pieces(text), lambda w: w != "")


def _counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    word = ""
    for ch in text.lower() + " ":
        if ch.isascii() and ch.isalnum():
            word += ch
        elif word:
            out[word] = out.get(word, 0) + 1
            word = ""
    return out


def anchors(weights: dict[str, float], threshold: float) -> set[str]:
    """The fewest heaviest words whose absence keeps any cosine below ``threshold``."""
    total = sum(w * w for w in weights.values())
    rest, out = total, set()
    for word in sorted(weights, key=lambda w: (-weights[w], w)):
        if rest < (threshold * threshold - 1e-9) * total:
            break
        out.add(word)
        rest -= weights[word] ** 2
    return out


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD,
         key: str = "doc_id", path: str = "path", text: str = "text", any_line: bool = False) -> DataFrame:
    """(key, path, licence, score, from_dir, status) for every row of ``files``.

    status is own (a line or the whole text reaches ``threshold``), inherited (the nearest
    ancestor directory that has a carrier; the best score and then the least path count) or none.
    A carrier is a file whose first line with words is the matching header, or a file with a
    licence file's name and any match; with ``any_line`` it is every file with a match, of any
    line or of the whole text.  Ties between licences go to the smaller name.  Null or empty text has no licence of its own; a null path inherits
    nothing and passes nothing on.  Rows that repeat are answered each; ``key`` only passes
    through.  An empty table gives an empty table.  Other columns of ``files`` are ignored.
    """
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    base = files.select(F.col(key).alias("_key"), F.col(path).alias("_path"), F.col(text).alias("_text"))
    vectors = [(name, i, _counts(t)) for name, texts in templates.items() for i, t in enumerate(texts)]
    vocabulary = sorted({w for _, _, v in vectors for w in v})

    # Texts that hold each template word; a row for each word of the templates.
    total = base.count()
    held = (base.select(F.explode(F.array_intersect(pieces(F.col("_text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
            .groupBy("word").count().collect())
    seen = {row["word"]: row["count"] for row in held}
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}
    rare = math.log(total + 1) + 1  # a word that no template has counts as unseen
    rows, heavy = [], set()
    for name, i, counts in vectors:
        weight = {w: n * idf[w] for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        heavy |= anchors(weight, threshold)
        rows += [(name, i, w, x / norm) for w, x in weight.items()]
    sides = F.broadcast(spark.createDataFrame(rows, "licence string, template int, word string, unit double"))
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))

    # Rows are told apart by a digest of all they hold; equal rows have equal answers.  Only
    # texts with an anchor are kept: the rest of the work reads this small table.
    anchored = F.array(*map(F.lit, sorted(heavy)))
    digest = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("_path").cast("string"), F.lit("\u0002")), F.coalesce("_text", F.lit(""))), 256)
    tagged = stored(base.select("_key", "_path", digest.alias("_row"), F.when(F.arrays_overlap(pieces(F.col("_text")), anchored), F.col("_text")).alias("_text")), "licence-texts")
    lines = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("unit_text")))
    marked = tagged.where("_text is not null").select("_row", "_path", "_text").distinct()
    has_anchor = F.arrays_overlap(pieces(F.col("unit_text")), anchored)
    by_line = marked.select("_row", F.explode(lines).alias("u")).select("_row", "u.line", "u.unit_text").where(has_anchor)
    whole = marked.select("_row", F.lit(-1).alias("line"), F.col("_text").alias("unit_text"))
    units = by_line.union(whole).distinct()
    terms = (units.select("_row", "line", F.explode(words(F.col("unit_text"))).alias("word")).groupBy("_row", "line", "word").agg(F.count("*").alias("tf"))
             .join(weights, "word", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(rare))))
    norms = terms.groupBy("_row", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = terms.join(sides, "word").groupBy("_row", "line", "licence", "template").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    cosines = dots.join(norms, ["_row", "line"]).select("_row", "line", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    own = cosines.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.min("line").alias("_least")) \
        .select("_row", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))
    header = cosines.where("line >= 0").groupBy("_row", "line").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))

    # A header is the first line with words; the best match of a file speaks where any line may.
    placed = marked.where("_path is not null")
    said = placed.select("_row", "_path").join(own, "_row").select("_path", (-F.col("score")).alias("s"), "licence")
    if not any_line:
        first = F.filter(F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("line"), (F.size(words(x)) > 0).alias("worded"))), lambda x: x["worded"])
        headed = (placed.join(header, "_row").withColumn("_first", F.try_element_at(first, F.lit(1))["line"]).where("line = _first")
                  .select("_path", "b.s", "b.licence"))
        said = headed.union(said.where(F.col("_path").rlike(LICENCE_FILE)))
    carriers = said.select(F.regexp_replace("_path", "/?[^/]*$", "").alias("dir"), F.struct("s", F.col("_path").alias("p"), "licence").alias("c"))
    speaks = carriers.groupBy("dir").agg(F.min("c").alias("c")).select("dir", F.col("c.licence").alias("dir_licence"), (-F.col("c.s")).alias("dir_score"))

    # Each directory once, not each file, looks for its nearest ancestor that speaks.
    dirs = tagged.where("_path is not null").select(F.regexp_replace("_path", "/?[^/]*$", "").alias("dir")).distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")) \
        .select(F.col("dir").alias("of"), "depth", F.concat_ws("/", F.slice(F.split("dir", "/"), 1, F.col("depth"))).alias("dir"))
    nearest = (ancestors.join(speaks, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "dir_licence", "dir_score")).alias("n"))
               .select(F.col("of").alias("_dir"), F.col("n.dir").alias("from_dir"), F.col("n.dir_licence").alias("dir_licence"), F.col("n.dir_score").alias("dir_score")))
    joined = (tagged.select("_key", "_path", "_row", F.regexp_replace("_path", "/?[^/]*$", "").alias("_dir"))
              .join(own, "_row", "left").join(nearest, "_dir", "left"))
    mine = F.col("licence").isNotNull()
    return joined.select(F.col("_key").alias(key), F.col("_path").alias(path), F.coalesce("licence", "dir_licence").alias("licence"),
                         F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
                         F.when(~mine, F.col("from_dir")).alias("from_dir"),
                         F.when(mine, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("status"))

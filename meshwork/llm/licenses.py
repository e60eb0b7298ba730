"""License scans: sparse TF-IDF cosine to templates, and inheritance down the path tree.

Every statement of a file (a line, a sentence of it, or a paragraph of several) is a
sparse vector over all of its terms; a term's weight is its count times
``ln((1 + N) / (1 + df)) + 1`` with document frequencies over all files.  The statement
of the greatest cosine with a template names the file's licence if the cosine is
``THRESHOLD`` or more (ties: the first template, then the first statement).  Statements
without a term that could bring the cosine up to the threshold are left out before any
term is counted; this loses nothing, since what is left of every template stays below
it, and a statement's other terms only add to its norm.

A file named as a licence file gives its licence to its directory (several in one:
the smallest path).  Files without a licence of their own take that of the nearest
ancestor directory that has one, found by joining each path's ancestors.

DataFrame functions alone.  Only numbers per template term, a fixed vocabulary, come
to the driver; the frequencies of the statements' other terms are joined.  Defined results: null or empty texts have no licence of their own but
may inherit; null paths have no ancestors; repeated paths are judged together as one
file of several texts, and each row gets its result; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, without

_GPL_NOTICE = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_CC_NOTICE = "This work is licensed under a Creative Commons {name} 4.0 International License."

#: Licence statements, notices and grants, one on a line, in the order that decides ties.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.\n"
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.\nMIT License\n"
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.\n"
    + _GPL_NOTICE.format(what="program", name="General Public License", version="3"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.\n" + _CC_NOTICE.format(name="Attribution-NonCommercial"),
    "Proprietary": "All rights reserved.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.\n"
    + _GPL_NOTICE.format(what="program", name="General Public License", version="2"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.\n"
    + _GPL_NOTICE.format(what="library", name="Lesser General Public License", version="3"),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.\n"
    + _GPL_NOTICE.format(what="library", name="Lesser General Public License", version="2.1"),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.\n"
    + _GPL_NOTICE.format(what="program", name="Affero General Public License", version="3"),
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.\n"
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    # The clause that only the longer one has comes first.
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.\n"
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.\n"
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.\n" + _CC_NOTICE.format(name="Attribution"),
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.\n" + _CC_NOTICE.format(name="Attribution-ShareAlike"),
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.\n" + _CC_NOTICE.format(name="Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.\n" + _CC_NOTICE.format(name="Attribution-NoDerivatives"),
}
THRESHOLD = 0.6
TERM = "[a-z0-9]+"
LICENCE_FILES = r"(^|/)(LICEN[CS]E|COPYING)(\.[a-z0-9]+)?$"
#: Sets of more terms than this are joined by a shuffle instead of a broadcast.
BROADCAST_TERMS = 1_000_000
#: Licensed directories up to this many are broadcast; more are joined by a shuffle, whose hot keys are split at run time.
BROADCAST_DIRS = 100_000


def statements(text: Column) -> Column:
    """Lines and sentences of a text, and then its paragraphs of several of them."""
    pieces = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\f]+", "$1\n"), "\n")
    return F.concat(pieces, F.array_except(F.split(text, "\n[^A-Za-z0-9\n]*+\n"), pieces))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def inverse_frequencies(files: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[dict[str, float], int]:
    """Weights of the vocabulary's terms, from all files, and the number of these."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), known)
    counts = files.select(F.explode(F.array_append(held, F.lit(""))).alias("term")).groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in counts}
    n = found.get("", 0)
    return {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary}, n


def term_weights(files: DataFrame, text_col: str, wanted: DataFrame, n: int) -> DataFrame:
    """``term, idf`` of the wanted terms, from all ``n`` files."""
    held = files.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"))).alias("term"))
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        counts = held.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    else:
        counts = held.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")
    return counts.select("term", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))


def deciding_terms(vectors: dict[str, dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """The rarest terms such that no statement without them reaches the threshold."""
    left, out = sorted(idf, key=lambda t: (idf[t], t)), []
    while left:
        norms = [math.sqrt(sum(w * w for t, w in v.items() if t in left) / sum(w * w for w in v.values())) for v in vectors.values()]
        if max(norms) < threshold:
            break
        out.append(left.pop())
    return out


def own_licences(files: DataFrame, path_col: str, text_col: str, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``path, license, score`` of files that state a licence."""
    counts = {(name, line): Counter(re.findall(TERM, line.lower())) for name, text in templates.items() for line in text.split("\n")}
    vocabulary = sorted({t for c in counts.values() for t in c})
    idf, n_files = inverse_frequencies(files, text_col, vocabulary)
    vectors = {key: {t: n * idf[t] for t, n in c.items()} for key, c in counts.items()}
    needed = deciding_terms(vectors, idf, threshold)
    spark = files.sparkSession
    rows = [
        (i, name, t, w / math.sqrt(sum(x * x for x in v.values())))
        for i, ((name, _), v) in enumerate(vectors.items()) for t, w in v.items()
    ]
    weights = spark.createDataFrame(rows, "template int, license string, term string, weight double")
    cue = "(?i)(?<![a-z0-9])(" + "|".join(sorted(needed)) + ")(?![a-z0-9])"
    # The cue is searched in the whole text first, so that only files that have it are cut into statements.
    stated = (
        files.filter(F.col(text_col).rlike(cue))
        .select(F.col(path_col).alias("path"), F.xxhash64(text_col).alias("text_key"), F.posexplode(statements(F.col(text_col))).alias("pos", "s"))
        .filter(F.col("s").rlike(cue))
    )
    term_counts = checkpointed(
        stated.select("path", "text_key", "pos", F.explode(terms(F.col("s"))).alias("term"))
        .groupBy("path", "text_key", "pos", "term").agg(F.count("*").alias("n"))
    )
    idfs = checkpointed(term_weights(files, text_col, checkpointed(term_counts.select("term").distinct()), n_files))
    weighed = term_counts.join(idfs, "term").withColumn("w", F.col("n") * F.col("idf"))
    # Repeated rows double every count and leave the cosine as it is.
    scored = weighed.join(F.broadcast(weights), "term").groupBy("path", "text_key", "pos", "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    norms = weighed.groupBy("path", "text_key", "pos").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    return (
        scored.join(norms, ["path", "text_key", "pos"]).withColumn("score", cosine).filter(F.col("score") >= threshold)
        .groupBy("path").agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "template", "pos")).alias("best"))
        .select("path", "best.license", "best.score")
    )


def ancestors(path: Column) -> Column:
    """Directories above a path, the nearest first, with their depth; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")),
    )


def scan_licenses(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD, licence_files: str = LICENCE_FILES,
) -> DataFrame:
    """The input without its text, and ``license, score, origin, license_path``."""
    own = checkpointed(own_licences(files.select(path_col, text_col), path_col, text_col, templates, threshold))
    given = (
        own.filter(F.col("path").rlike(licence_files))
        .select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.struct("path", "license", "score").alias("l"))
        .groupBy("dir").agg(F.min("l").alias("l"))
    )
    paths = files.select(F.col(path_col).alias("path")).filter("path IS NOT NULL").distinct()
    above = paths.join(own.select("path"), "path", "left_anti").select("path", F.explode(ancestors(F.col("path"))).alias("a"))
    # A directory that holds a third of all files must not be one task: licensed directories go to the files while they are few.
    given = checkpointed(given)
    few = given.limit(BROADCAST_DIRS + 1).count() <= BROADCAST_DIRS
    inherited = (
        above.select("path", "a.depth", "a.dir").join(F.broadcast(given) if few else given, "dir")
        .groupBy("path").agg(F.max_by("l", "depth").alias("l"))
        .select("path", "l.license", "l.score", F.lit("inherited").alias("origin"), F.col("l.path").alias("license_path"))
    )
    origin = F.when(F.col("path").rlike(licence_files), "licence file").otherwise("header")
    found = own.select("path", "license", "score", origin.alias("origin"), F.col("path").alias("license_path")).unionByName(inherited)
    found = found.withColumnRenamed("path", "found_path")
    base = without(files, text_col, "license", "score", "origin", "license_path")
    return base.join(found, base[path_col] == found["found_path"], "left").drop("found_path")

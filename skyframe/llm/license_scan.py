"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Terms are lower-case runs of letters, digits and dots, each a dimension of its own, with the idf of its document count
over the whole corpus: all terms are counted in one aggregate, and the counts are joined to the terms that are compared.

A template is compared with stretches of a file that have as many terms as it has, wherever its lines are broken. For
each template, ``anchors`` are its heaviest terms such that the other terms alone can't reach the threshold, so a
stretch without any anchor is below it. Wherever an anchor stands in a file, the stretch that begins as far before it as
it stands in the template is compared, cut off at the ends of the file; so a notice is met in line with itself, whether
it fills several lines, a part of a long line or a paragraph of a whole licence text. Files without anchors are skipped,
and of others only the surroundings of anchors leave their row.

An ``SPDX-License-Identifier`` tag names the licence itself, with score 1; ``-only``, ``-or-later`` and ``+`` behind it are
left off. A notice that is part of other licences' texts counts only where none of these is found (:func:`covers`).

A file takes the best licence of its own; else that of the nearest directory above it that has a licence file. Paths
join directories by equality, one row for each ancestor of a file without a licence of its own.

Defined cases: a null or empty text has no licence of its own; a null path inherits nothing; equal scores go to the
licence that comes first by name, several licence files of one directory to the best score; repeated rows keep their
rows; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import read_table, small_side, stored, unclash

#: Notices by licence, in their usual wording.
TEMPLATES = [
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MS-PL", "Licensed under the Microsoft Public License."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Licensed under the Do What The Fuck You Want To Public License, Version 2."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty."),
]
#: Fixed value: a clause that one licence has more than another, by the first words of its template.
CLAUSES = {"Neither the name of": "BSD-2-Clause"}


def covers(name: str, text: str) -> list[str]:
    """Licences that a template's presence rules out: rights are reserved in many licences, and a further clause makes another one."""
    return ([] if name == "Proprietary" else ["Proprietary"]) + [less for first, less in CLAUSES.items() if text.startswith(first)]


#: Fixed value: the tag in front of an identifier.
SPDX = r"SPDX-License-Identifier:\s*\(*\s*([A-Za-z0-9.-]*[A-Za-z0-9])"
LICENCE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
LEAST = 0.7
_TERM = r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]"


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def term_column(text: Column) -> Column:
    """The same as an expression: pieces between all other characters, without dots at their ends."""
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.]+")
    return F.array_remove(F.transform(pieces, lambda w: F.btrim(w, F.lit("."))), "")


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in templates for t in terms(text)})


def document_counts(files: DataFrame) -> DataFrame:
    """(term, n): in how many files each term is."""
    return files.select(F.explode_outer(F.array_distinct(term_column(F.col("text")))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


class Weights:
    """Template vectors in the space of a corpus, and where each anchor of a template stands in it."""

    def __init__(self, templates: list[tuple[str, str]], total: int, counts: dict[str, int], least: float):
        self.idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in vocabulary(templates)}
        self.total = total
        self.names = [(k, name, covers(name, text)) for k, (name, text) in enumerate(templates)]
        self.rows, self.places, self.longest = [], [], 1
        for k, (name, text) in enumerate(templates):
            found = terms(text)
            self.longest = max(self.longest, len(found))
            vector = {w: found.count(w) * self.idf[w] for w in set(found)}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.rows += [(k, w, v / norm) for w, v in sorted(vector.items())]
            rest = norm * norm
            for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if rest < (least * norm) ** 2:
                    break
                self.places += [(w, k, at, len(found)) for at, x in enumerate(found) if x == w]
                rest -= v * v
        self.anchors = sorted({w for w, *_ in self.places})


def stretches(files: DataFrame, weights: Weights) -> DataFrame:
    """(key, template, first, terms): stretches of files (key, text) that lie in line with a template by one of its anchors."""
    spark = files.sparkSession
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, weights.anchors)) + r")(?![a-z0-9])"
    # Texts are tested for anchors before any is cut into terms.
    cut = stored(files.where(F.col("text").rlike(pattern)).select("key", term_column(F.col("text")).alias("_all")), "license-texts")
    size, reach = F.size("_all"), weights.longest
    hits = F.filter(F.transform("_all", lambda w, i: F.struct(w.alias("term"), i.alias("at"))), lambda x: x["term"].isin(weights.anchors))
    around = lambda x: F.slice("_all", F.greatest(x["at"] - reach, F.lit(0)) + 1, F.lit(2 * reach))
    near = cut.select("key", size.alias("_size"), F.explode(F.transform(hits, lambda x: F.struct(x["term"].alias("term"), x["at"].alias("at"), around(x).alias("near")))).alias("_x")).select("key", "_size", "_x.*")
    # One row for each place of an anchor in a template: bounded by the templates, a parameter.
    table = spark.createDataFrame(weights.places, "term string, template int, place int, width int")
    laid = near.join(F.broadcast(table), "term").withColumn("first", F.greatest(F.col("at") - F.col("place"), F.lit(0)))
    last = F.least(F.col("at") - F.col("place") + F.col("width"), F.col("_size"))
    begin = F.col("first") - F.greatest(F.col("at") - reach, F.lit(0)) + 1
    return laid.select("key", "template", "first", F.slice("near", begin, last - F.col("first")).alias("terms")).dropDuplicates(["key", "template", "first", "terms"])


def own_licenses(files: DataFrame, counts: DataFrame, weights: Weights, least: float = LEAST) -> DataFrame:
    """(key, license, score) of files (key, text) with a notice or tag of their own."""
    each = stretches(files, weights).withColumn("place", F.struct("first", F.size("terms").alias("n"), F.xxhash64("terms").alias("h")))
    each = each.select("key", "template", "place", F.explode("terms").alias("term")).groupBy("key", "template", "place", "term").agg(F.count("*").alias("tf"))
    idf = F.log((1 + weights.total) / (1 + F.col("n"))) + 1
    valued = each.join(small_side(counts), "term").select("key", "template", "place", "term", (F.col("tf") * idf).alias("value"))
    # One row for each template and for each of its terms.
    spark = files.sparkSession
    table = spark.createDataFrame(weights.rows, "template int, term string, weight double")
    names = spark.createDataFrame(weights.names, "template int, license string, covers array<string>")
    joined = valued.join(F.broadcast(table), ["template", "term"], "left")
    sums = joined.groupBy("key", "template", "place").agg(F.sqrt(F.sum(F.pow("value", F.lit(2)))).alias("norm"), F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = sums.join(F.broadcast(names), "template").select("key", "license", "covers", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    tag = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(-only|-or-later)$", "")
    tagged = files.where(F.col("text").contains("SPDX-License-Identifier:")).select("key", tag.alias("license"), F.array(F.lit("Proprietary")).alias("covers"), F.lit(1.0).alias("score")).where("license <> ''")
    # A file has few licences: those of the templates and its tag.
    found = scored.unionByName(tagged).groupBy("key").agg(F.collect_set(F.struct((-F.col("score")).alias("minus"), "license")).alias("_all"), F.flatten(F.collect_set("covers")).alias("_covered"))
    top = F.array_min(F.filter("_all", lambda x: ~F.array_contains("_covered", x["license"])))
    return found.select("key", top.alias("_top")).select("key", F.col("_top.license").alias("license"), (-F.col("_top.minus")).alias("score"))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, path, license, score, origin (own, inherited, none) and the directory it came from, of files (doc_id, path, text)."""
    templates = templates or TEMPLATES
    files = unclash(files, ["doc_id", "path", "text"])
    counts = stored(document_counts(files), "document-counts")
    known = {r["term"]: r["n"] for r in counts.where(F.col("term").isin(vocabulary(templates))).collect()}  # the templates' terms only
    weights = Weights(templates, files.count(), known, least)
    keyed = files.withColumn("key", F.struct("doc_id", "path", F.xxhash64("text").alias("print")))
    found = stored(own_licenses(keyed.select("key", "text"), counts, weights, least), "own-licenses").select(F.col("key.doc_id").alias("_d"), F.col("key.path").alias("_p"), F.col("key.print").alias("_t"), "license", "score")
    rows = files.select("doc_id", "path", F.xxhash64("text").alias("_own"))
    same = rows["doc_id"].eqNullSafe(found["_d"]) & rows["path"].eqNullSafe(found["_p"]) & (rows["_own"] == found["_t"])
    judged = rows.join(found, same, "left").select("doc_id", "path", "license", "score")

    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    declared = found.where(F.col("_p").rlike(LICENCE_NAMES)).withColumn("path", F.col("_p")).select(folder.alias("folder"), "license", "score")
    folders = declared.groupBy("folder").agg(F.max(F.struct("score", "license")).alias("_top")).select("folder", F.col("_top.license").alias("_license"), F.col("_top.score").alias("_score"))
    bare = judged.where("license IS NULL AND path IS NOT NULL").select("path").distinct()
    names = F.split(folder, "/")
    above = F.concat(F.transform(F.sequence(F.size(names), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(names, 1, k), "/")), F.when(folder != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    climbs = bare.select("path", F.posexplode(above).alias("up", "folder")).join(folders, "folder")
    nearest = climbs.groupBy("path").agg(F.min(F.struct("up", "folder", "_license", "_score")).alias("_n"))
    out = judged.join(nearest, "path", "left")
    own = F.col("license").isNotNull()
    inherited = ~own & F.col("_n").isNotNull()
    return out.select("doc_id", "path", F.coalesce("license", "_n._license").alias("license"), F.round(F.coalesce("score", "_n._score"), 6).alias("score"), F.when(own, "own").when(inherited, "inherited").otherwise("none").alias("origin"), F.when(inherited, F.col("_n.folder")).alias("folder"))


def sample_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language and a numbered folder; one in ten is a licence file at one of the levels."""
    tree = [F.col("source"), F.concat_ws("/", "source", "lang"), F.concat_ws("/", F.col("source"), F.col("lang"), (F.col("doc_id") % 64).cast("string"))]
    licence = F.concat(F.when(F.col("doc_id") % 3 == 0, tree[0]).when(F.col("doc_id") % 3 == 1, tree[1]).otherwise(tree[2]), F.lit("/LICENSE"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 10 == 1, licence).otherwise(F.concat(tree[2], F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(sample_files(read_table(spark, sf_dir, "documents")))

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from skyframe.llm import license_scan as l


def brute(files):
    """Every stretch that lies in line with a template by an anchor, each template against each file, in plain Python."""
    total = len(files)
    df = Counter(w for _, _, t in files for w in set(l.terms(t or "")))
    idf = {w: math.log((1 + total) / (1 + df[w])) + 1 for w in [*df, *l.vocabulary(l.TEMPLATES)]}
    made = []
    for name, template in l.TEMPLATES:
        found = l.terms(template)
        tv = {w: found.count(w) * idf[w] for w in found}
        norm = math.sqrt(sum(v * v for v in tv.values()))
        rest, anchors = norm * norm, set()
        for w in sorted(tv, key=lambda w: (-tv[w], w)):
            if rest < (l.LEAST * norm) ** 2:
                break
            anchors.add(w)
            rest -= tv[w] ** 2
        made.append((name, template, found, tv, norm, anchors))
    own = {}
    for key, path, text in files:
        scores, covered = {}, set()
        tokens = l.terms(text or "")
        for name, template, found, tv, norm, anchors in made:
            for start in {p - o for p, w in enumerate(tokens) if w in anchors for o, x in enumerate(found) if x == w}:
                part = Counter(tokens[max(start, 0) : start + len(found)])
                own_norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in part.items()))
                score = round(sum(n * idf[w] * tv.get(w, 0) for w, n in part.items()) / own_norm / norm, 9)
                if score >= l.LEAST:
                    scores[name] = max(scores.get(name, 0), score)
                    covered |= {"Proprietary"} if name != "Proprietary" else set()
                    covered |= {"BSD-2-Clause"} if template.startswith("Neither the name") else set()
        if m := re.search(l.SPDX, text or ""):
            scores[re.sub("(-only|-or-later)$", "", m[1])] = 1.0
            covered.add("Proprietary")
        own[(key, path)] = min(((-s, n) for n, s in scores.items() if n not in covered), default=None)
    folders = {}
    for key, path, _ in files:
        if path and re.search(l.LICENCE_NAMES, path) and own[(key, path)]:
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            s, n = own[(key, path)]
            folders[folder] = max(folders.get(folder, (0, "")), (-s, n))
    out = []
    for key, path, _ in files:
        if own[(key, path)]:
            out.append((key, own[(key, path)][1], "own", None))
            continue
        at = path
        hit = None
        while at:
            at = at.rsplit("/", 1)[0] if "/" in at else ""
            if at in folders:
                hit = (key, folders[at][1], "inherited", at)
                break
        out.append(hit or (key, None, "none", None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["license"], r["origin"], r["folder"]) for r in df.collect()), key=str)


def test_documents(spark):
    files = l.sample_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [tuple(r) for r in files.select("doc_id", "path", "text").collect()]
    got = result(l.scan(files))
    assert got == brute(rows) and {r[2] for r in got} == {"own", "inherited", "none"}


def test_notices_with_words_around_them(spark):
    """A notice counts with any words around it; its words apart from each other don't make one."""
    common = "this is all of the code that you may see in here and it is good to have on the list of files"
    rows = [(k, f"d/{k}.txt", f"{common} {k}") for k in range(40)]
    rows += [(100, "e/1.txt", "the code in this is Released under the MIT License."), (101, "e/2.txt", "Licensed under the Apache License, Version 2.0 (the License) of all"), (102, "e/3.txt", "Released under the MIT License. zig zag zug zeg zog zyg zaz zez ziz zoz"), (103, "g/4.txt", "Released zig zag zug zeg under zog zyg the zaz zez MIT ziz zoz zuz License.")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = result(l.scan(files))
    assert got == brute(rows)
    found = {k: name for k, name, _, _ in got}
    assert found[100] == "MIT" and found[101] == "Apache-2.0" and found[102] == "MIT" and found[103] is None


def test_odd_rows(spark):
    rows = [(1, "LICENSE", "junk\nReleased under the MIT License.\nmore"), (2, "a/b/c.txt", None), (3, "a/COPYING", "All rights reserved."), (4, "a/b/d.txt", ""), (5, None, "x"), (6, "z.txt", "no licence " * 20_000), (7, "a/LICENSE.md", "Licensed under CC BY 4.0."), (8, "q/e.txt", "// licensed under the apache license version 2.0")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit(1)).withColumn("key", F.lit("x"))
    assert result(l.scan(files)) == brute(rows)
    twice = l.scan(files.unionByName(files.where("doc_id IN (2, 3)"))).collect()
    assert len(twice) == 10
    assert l.scan(files.limit(0)).count() == 0


def test_every_notice_is_its_own_licence(spark):
    """Each template, and each with words around it, goes to its licence, alone and among its relatives."""
    rows = [(k, f"d/{k}.txt", f"some words\n{text}\nmore words") for k, (_, text) in enumerate(l.TEMPLATES)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = result(l.scan(files))
    assert got == brute(rows)
    assert {k: name for k, name, _, _ in got} == {k: name for k, (name, _) in enumerate(l.TEMPLATES)}


HEADERS = {
    "GPL-2.0": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY""",
    "LGPL-3.0": """// This library is free software: you can redistribute it and/or modify
// it under the terms of the GNU Lesser General Public License as
// published by the Free Software Foundation, either version 3 of the
// License, or (at your option) any later version.""",
    "LGPL-2.1": """ This library is free software; you can redistribute it and/or
 modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either
 version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "BSD-2-Clause": """Copyright 2020 Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice
2. Redistributions in binary form must reproduce the above copyright notice""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed */""",
}


def test_usual_headers(spark):
    """Headers as files have them, wrapped or on one line, with comment marks, among other text; written without the templates."""
    filler = lambda k: " ".join(f"word{(k * 7 + j * j) % 900}" for j in range(60))
    rows = [(k, f"f/{k}.txt", filler(k)) for k in range(200)]
    wanted = {}
    for k, (name, text) in enumerate(HEADERS.items()):
        for j, around in enumerate((text, f"{filler(k)}\n{text}\n{filler(k + 1)}", f"{filler(k)} {' '.join(text.split())} {filler(k + 2)}")):
            rows.append((1000 + 10 * k + j, f"h/{k}/{j}.c", around))
            wanted[1000 + 10 * k + j] = name
    tags = {"SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0", "# SPDX-License-Identifier: (MIT OR Zlib)": "MIT", "// SPDX-License-Identifier: EUPL-1.2": "EUPL-1.2", "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1"}
    for k, (line, name) in enumerate(tags.items()):
        rows.append((5000 + k, f"s/{k}.c", f"{filler(k)}\n{line}\n{filler(k)}"))
        wanted[5000 + k] = name
    got = result(l.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    assert got == brute(rows)
    assert {k: name for k, name, *_ in got if k >= 1000} == wanted and all(name is None for k, name, *_ in got if k < 200)

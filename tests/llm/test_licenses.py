import math
import re
from collections import Counter

from pyspark.sql import functions as F

from outrider.llm import licenses


def brute(rows, templates, least=licenses.LEAST):
    """(doc_id, path, licence, similarity, origin, dir) one file at a time."""
    words = lambda t: re.findall(r"[^\W_]+(?:\.\d+)*", (t or "").lower())
    kinds = [(name, words(t)) for name, t in sorted(set(templates))]
    every = [words(t) for *_, t in rows] + [w for _, w in kinds]
    df = Counter(w for ws in every for w in set(ws))
    idf = {w: math.log((1 + len(every)) / (1 + n)) + 1 for w, n in df.items()}
    vector = lambda ws: {w: n * idf[w] for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def cosine(ws, kind):
        v, t = vector(ws), vector(kind)
        return round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 9)

    own = []
    for _, _, text in rows:
        ws, found = words(text), []
        for _, kind in kinds:
            if not set(ws) & set(kind):
                continue
            t = vector(kind)
            unit = {w: round(licenses.UNIT * x * idf[w] / norm(t)) for w, x in t.items()}
            cuts = [ws[k : k + len(kind)] for k in range(max(1, len(ws) - len(kind) + 1))]
            cut = max(cuts, key=lambda x: sum(unit.get(w, 0) for w in x))
            score, licence = min((-cosine(cut, other), name) for name, other in kinds)
            if -score >= least:
                found.append((score, licence, -len(cut)))
        own.append((*min(found), len(ws)) if found else None)
    dirs = {}
    for (_, path, _), s in zip(rows, own, strict=True):
        if s and path is not None and (re.match(r"(?i)(licen[sc]e|copying)", path.rpartition("/")[2]) or -2 * s[2] >= s[3]):
            d = path.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, s[:2]), s[:2])
    out = Counter()
    for (i, path, _), s in zip(rows, own, strict=True):
        if s:
            out[i, path, s[1], -s[0], "own", None] += 1
            continue
        at = path
        while at:
            at = at.rpartition("/")[0]
            if at in dirs:
                break
        else:
            at = None
        if path is not None and at is not None and at in dirs:
            out[i, path, dirs[at][1], -dirs[at][0], "inherited", at] += 1
        else:
            out[i, path, None, None, "none", None] += 1
    return out


def test_scan_equals_brute_force(spark):
    apache, mit, gpl = (t for n, t in licenses.TEMPLATES[:4] if n in ("Apache-2.0", "GPL-3.0") or t == "Released under the MIT License.")
    long = " word" * 300
    rows = [
        (1, "a/b/c/x.txt", "plain text"),
        (2, "a/LICENSE", apache),
        (3, "a/b/LICENSE", "some words\n" + mit),
        (4, "a/b/y.txt", f"{gpl}\n" + long),
        (5, "a/d/z.txt", None),
        (6, "q/z.txt", ""),
        (7, None, "nothing"),
        (8, None, apache.upper()),
        (9, "top.txt", "no licence that anyone knows of" + long),
        (9, "top.txt", "no licence that anyone knows of" + long),
        (10, "a/b", "copyright"),
        (11, "a/b/c/d/e/f", "  " + mit + "  "),
        (12, "x//y", "text"),
        (13, "x/LICENSE", "licensed " * 200 + "\nAll rights reserved."),
    ]
    frame = spark.createDataFrame([(i, p, t, "clash", 3) for i, p, t in rows], "doc_id bigint, file string, text string, licence string, row int")
    templates = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    got = Counter(tuple(r) for r in licenses.scan(frame, templates, F.col("file")).collect())
    assert got == brute(rows, licenses.TEMPLATES)
    assert licenses.scan(frame.limit(0), templates, F.col("file")).count() == 0
    assert {r.origin for r in licenses.scan(frame, templates.limit(0), F.col("file")).collect()} == {"none"}


def test_licence_files_of_any_length(spark):
    mit, bsd, gpl = (next(t for n, t in licenses.TEMPLATES if n == name and len(t) > 300) for name in ("MIT", "BSD-3-Clause", "GPL-3.0"))
    chapters = " ".join(f"section {k} covers clause {k % 97} of the agreement" for k in range(900))
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020 Somebody\n\n" + mit),
        (2, "a/src/x.py", "import os"),
        (3, "b/COPYING.txt", gpl + "\n" + chapters),
        (4, "b/src/deep/er/y.c", "int main"),
        (5, "c/notes.txt", chapters + " Licensed under the Apache License, Version 2.0. " + chapters),
        (6, "c/other.txt", "not a licence"),
        (7, "d/any.txt", "# " + bsd.replace("\n", "\n# ")),
        (8, "d/z.txt", "plain words"),
        (9, "e/long.txt", " ".join(["Released under the MIT License."] * 400)),
        (10, None, "x" * 50_000 + " the " * 5000),
    ]
    frame = spark.createDataFrame([(i, p, t) for i, p, t in rows], "doc_id bigint, file string, text string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    got = Counter(tuple(r) for r in licenses.scan(frame, templates, F.col("file")).collect())
    assert got == brute(rows, licenses.TEMPLATES)
    short = {(i, licence, origin) for i, _, licence, _, origin, _ in got}
    assert {(1, "MIT", "own"), (2, "MIT", "inherited"), (4, "GPL-3.0", "inherited"), (5, "Apache-2.0", "own"), (6, None, "none"), (8, "BSD-3-Clause", "inherited")} <= short


def test_notices_that_are_no_line_of_their_own(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions below are met."
    rows = [
        (1, bsd, "BSD-3-Clause"),
        (2, "# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        (3, "// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        (4, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
        (5, "word " * 400 + "Released under the MIT License." + " word" * 400, "MIT"),
        (6, "# Licensed under the\n# Apache License,\n# Version 2.0", "Apache-2.0"),
        (7, "# Redistribution and use in source and\n# binary forms, with or without\n# modification, are permitted", "BSD-3-Clause"),
        (8, "All", None),
        (9, "the album was released under the moon and all was well", None),
        (10, "# SPDX-License-Identifier: Other-1.0", None),
    ]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    got = {r.doc_id: r.licence for r in licenses.scan(frame, templates, F.lit(None).cast("string")).collect()}
    assert got == {i: want for i, _, want in rows}

"""Licence scans: headers, notices and licence files against templates, and inheritance along paths.

Texts and templates are compared by the sparse TF-IDF cosine; how rare a word is, is counted over all files and
templates. Of each file, for each template, the stretch of words as long as the template that has the largest
product with it is scored, across line breaks and wherever it stands: a header, a notice in a long line, or a
licence file as a whole. A stretch's score is worked out once, however many files carry it. A file is passed over
only if the template's words that it has can't reach the threshold between them. An SPDX identifier is its
licence. A file's licence is that of its best stretch. A file with none inherits that of the nearest directory
above it that has a licence file, found by joining the path's ancestors with the directories that have one. A
licence file is one by its name, or has a stretch that is half of its words or more.

Cases: a null or empty text has no licence of its own; a null path has no directory and inherits
nothing; equal scores go to the smaller licence name; of equal products the first stretch counts; of a directory's
licence files the most similar counts; repeated rows are scanned alike; an empty table, or none of the templates,
gives no licence; very long lines and texts are scored in whole; other columns stay only if named.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.llm.common import split_join, text_of, written
from outrider.llm.pii import running
from outrider.llm.quality import let

TOKEN = r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"
SPDX = r"(?i)SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+?)(?:-only|-or-later|\+)?(?![A-Za-z0-9.+-])"
LICENCE_FILE = r"(?i)^(?:un)?(?:licen[sc]es?|copying|copyright|notice)(?:[._-].*)?$"
LEAST = 0.5
#: Products are compared in millionths, as whole numbers have one sum in any order.
UNIT = 1_000_000
#: Short forms that licences are declared by, then the licences' own texts or notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("Proprietary", "All rights reserved."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    ),
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def frequencies(files: DataFrame, templates: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """(token, df) over files and templates, and how many these are."""
    texts = files.select(text_of(text_col).alias("text")).unionByName(templates.select("licence", "text").distinct().select("text"))
    each = texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return written(each.groupBy("token").agg(F.count("*").alias("df")), "frequencies"), texts.count()


@dataclass
class Template:
    """A template's number of tokens, its tokens' shares of its length and what a word adds to a product, and the words of which a similar text has one."""

    length: int
    shares: dict[str, float]
    units: dict[str, int]
    anchors: list[str]


def weighed(templates: DataFrame, df: DataFrame, total: int, least: float) -> list[Template]:
    """The templates; what comes to the driver is their own tokens."""
    held = templates.select("licence", "text").distinct().select(F.xxhash64("licence", "text").alias("t"), F.explode(tokens(F.col("text"))).alias("token"))
    counts: dict[int, Counter] = {}
    idf = {}
    for r in held.groupBy("t", "token").agg(F.count("*").alias("tf")).join(df, "token").collect():
        counts.setdefault(r.t, Counter())[r.token] = r.tf
        idf[r.token] = math.log((1 + total) / (1 + r.df)) + 1
    out = []
    for _, bag in sorted(counts.items()):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        shares = {w: (n * idf[w] / norm) ** 2 for w, n in sorted(bag.items())}
        common, spent = set(), 0.0
        for w, x in sorted(shares.items(), key=lambda p: (p[1], p[0])):
            if spent + x >= least * least - 1e-9:
                break
            common.add(w)
            spent += x
        units = {w: round(UNIT * n * idf[w] ** 2 / norm) for w, n in sorted(bag.items())}
        out.append(Template(sum(bag.values()), shares, units, [w for w in shares if w not in common]))
    return out


def stretches(words: Column, known: list[Template], least: float) -> Column:
    """Of each template that ``words`` could be similar to, the stretch with the largest product, as (line, size)."""
    held = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    def best(w: Column, t: Template) -> Column:
        has = F.array_intersect(w, F.array(*[F.lit(x) for x in t.shares]))
        share = F.aggregate(has, F.lit(0.0), lambda a, x: a + F.element_at(held(t.shares), x))
        near = F.arrays_overlap(w, F.array(*[F.lit(x) for x in t.anchors])) & (share >= least * least - 1e-9)
        worth = F.transform(w, lambda x: F.coalesce(F.element_at(held(t.units), x), F.lit(0)).cast("bigint"))

        def top(v: Column) -> Column:
            upto = running(v, lambda a, b: a + b, F.lit(0).cast("bigint"))
            whole = lambda p: F.concat(p, F.array(F.element_at(p, -1) + F.element_at(v, -1)))
            last = F.greatest(F.size(w) - t.length, F.lit(0))
            at = lambda p: F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((F.get(p, F.least(k + t.length, F.size(w))) - F.get(p, k)).alias("product"), (-k).alias("back")))
            return let(let(upto, whole), lambda p: F.array_max(at(p)))

        cut = lambda b: let(F.slice(w, 1 - b["back"], F.lit(t.length)), lambda x: F.struct(F.array_join(x, " ").alias("line"), F.size(x).alias("size")))
        return F.when(near, let(let(worth, top), cut))

    none = F.array().cast("array<struct<line:string,size:int>>")
    if not known:
        return none
    some = F.array(*[F.lit(x) for x in sorted({a for t in known for a in t.anchors})])
    return let(words, lambda w: F.when(F.arrays_overlap(w, some), F.filter(F.array(*[best(w, t) for t in known]), lambda x: x.isNotNull())).otherwise(none))


def similar(lines: DataFrame, templates: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """(line, licence, similarity) of the best template for each distinct ``line``."""
    weigh = F.col("tf") * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1)
    known = templates.select("licence", "text").distinct().select("licence", F.xxhash64("licence", "text").alias("template"), F.explode(tokens(F.col("text"))).alias("token"))
    weighted = known.groupBy("licence", "template", "token").agg(F.count("*").alias("tf")).join(df, "token").withColumn("w", weigh)
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn"))
    weighted = weighted.join(norms, "template").select("template", "licence", "token", (F.col("w") / F.col("tn")).alias("tw"))
    own = lines.select("line", F.explode(F.split("line", " ", -1)).alias("token")).groupBy("line", "token").agg(F.count("*").alias("tf"))
    own = own.join(df, "token").withColumn("w", weigh)
    lengths = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ln"))
    dots = own.join(weighted, "token").groupBy("line", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(lengths, "line").select("line", "licence", F.round(F.col("dot") / F.col("ln"), 9).alias("similarity"))
    best = scored.groupBy("line", "licence").agg(F.max("similarity").alias("similarity"))
    top = best.groupBy("line").agg(F.min(F.struct((-F.col("similarity")).alias("back"), "licence")).alias("b"))
    return top.select("line", F.col("b.licence").alias("licence"), (-F.col("b.back")).alias("similarity"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, with how far up they are; the root is the empty string."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    above = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.struct(k.alias("up"), F.array_join(F.slice(parts, 1, F.greatest(depth - k + 1, F.lit(0))), "/").alias("dir")))
    return F.when(path.isNull(), F.array().cast("array<struct<up:int,dir:string>>")).otherwise(above)


def scan(files: DataFrame, templates: DataFrame, path: Column, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), least: float = LEAST) -> DataFrame:
    """``columns``, path, licence, similarity, origin (own, inherited or none) and the directory it comes from."""
    df, total = frequencies(files, templates, text_col)
    known = weighed(templates, df, total, least)
    text = text_of(text_col)
    told = F.when(F.lower(text).contains("spdx-license-identifier"), F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = let(tokens(text), lambda w: F.struct(F.size(w).alias("words"), stretches(w, known, least).alias("lines")))
    rows = files.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)], path.alias("path"), told.alias("told"), found.alias("found"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.select("*", "found.words", "found.lines").drop("found"), "files")
    lines = rows.select("row", F.explode("lines").alias("x")).select("row", "x.line", "x.size")
    distinct = lines.select("line").distinct()
    names = templates.select("licence", F.lower("licence").alias("name")).distinct()
    named = rows.select("row", F.explode("told").alias("name")).withColumn("name", F.lower("name")).join(names, "name").select("row", "licence", F.lit(1.0).alias("similarity"), F.lit(0).alias("size"))
    scores = written(similar(distinct, templates, df, total).filter(F.col("similarity") >= least), "scores")
    every = lines.join(scores, "line").select("row", "licence", "similarity", "size").unionByName(named)
    found = every.groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("back"), "licence", (-F.col("size")).alias("less"))).alias("b"))
    own = rows.drop("lines", "told").join(found.select("row", F.col("b.licence").alias("licence"), (-F.col("b.back")).alias("similarity"), (-F.col("b.less")).alias("size")), "row", "left")
    own = written(own, "licensed")
    home = F.get(ancestors(F.col("path")), F.lit(0))["dir"]
    is_file = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) | (2 * F.col("size") >= F.col("words"))
    files_of = own.filter(F.col("licence").isNotNull() & F.col("path").isNotNull() & is_file).withColumn("dir", home)
    dirs = files_of.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("back"), "licence")).alias("b")).select("dir", F.col("b.licence").alias("up_licence"), (-F.col("b.back")).alias("up_similarity"))
    homes = own.filter("licence is null and path is not null").select(home.alias("home")).distinct()
    near = homes.select("home", F.explode(ancestors(F.concat("home", F.lit("/x")))).alias("a")).select("home", "a.up", "a.dir").join(dirs, "dir")
    near = near.groupBy("home").agg(F.min(F.struct("up", "dir", "up_licence", "up_similarity")).alias("n")).select("home", "n.dir", "n.up_licence", "n.up_similarity")
    joined = split_join(own.withColumn("home", F.when(F.col("licence").isNull(), home)), near, "home", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("up_licence").isNotNull(), "inherited").otherwise("none")
    return joined.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)], "path", F.coalesce("licence", "up_licence").alias("licence"), F.coalesce("similarity", "up_similarity").alias("similarity"), origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("dir")).alias("licence_dir"))

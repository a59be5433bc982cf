"""Licence scan: sparse TF-IDF cosine of licence lines to templates, then inheritance from the nearest directory.

Sections are runs of up to 8 adjacent lines, paragraphs and whole texts, without any word they must have; a bound on the
cosine that loses none leaves out those that can't reach ``least``.  Terms are weighted tf * idf, where the document
frequencies are counted over the lines that name a licence and the short forms.  A file's licence is its best section's,
if that reaches ``least``; an SPDX identifier names it exactly.  Apache, GPL, LGPL and MPL texts are known by their
headers and opening blocks, CC ones by their short forms, not by the whole of the licence's text.

A licence file, by its name or because its licence lines are at least half its words, gives its licence to its
directory.  A file without a licence of its own takes that of its nearest ancestor directory: each different directory is
joined with all its ancestors by path, and the deepest one that has a licence wins.

Defined results: a null text has no licence of its own; a null path has no directory; equal scores go to the template
first in code-point order, several licence files of a directory to the best score, then the least path; repeated rows
each return (their sections are counted as one); an empty table gives no rows; other columns never take part.
"""

from __future__ import annotations

import collections
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import use_shared_dir

# Short forms of public licences' notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0, Creative Commons Attribution NonCommercial 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "proprietary": "Copyright. All rights reserved. No part may be copied without written permission",
    "all-rights-reserved": "All rights reserved",
    "unlicense": "This is free and unencumbered software released into the public domain under the Unlicense",
}
#: Whole texts and standard headers, scored like the short forms; long licences by the header and the block they open with.
WHOLE = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Licences by their SPDX identifiers, which are read exactly and not scored.
SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)"
SPDX_IDS = {**{t: t for t in TEMPLATES}, "bsd-3-clause": "bsd-3-clause", "gpl-3.0-only": "gpl-3.0", "gpl-3.0-or-later": "gpl-3.0", "gpl-3.0+": "gpl-3.0", "lgpl-2.1-only": "lgpl-2.1", "lgpl-2.1-or-later": "lgpl-2.1", "lgpl-2.1+": "lgpl-2.1"}
#: What the long ones of WHOLE need at least: common words alone bring ordinary prose to 0.52 here.
WHOLE_LEAST = 0.7
#: Lines of a run; longer ones are scored as paragraphs and as the whole text.
RUN_LINES = 8
#: Terms whose document frequencies come to the driver, beside those of the templates.
FREQUENT = 50_000
NAMES_LICENCE = r"(?i)licen[cs]e|copyright|spdx|public domain|all rights reserved"
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([.-].*)?$"
TERM = r"[a-z0-9]+"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def directory_of(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _runs(files: DataFrame, known: dict[str, dict[str, float]], needs: list[float], idf: dict[str, float], rare: float) -> DataFrame:
    """path, line, n_all, terms of the runs of adjacent lines, paragraphs and whole texts that may reach a template's need.

    Bounds decide: a run's product with a template is the sum of its lines' products, and its norm is no less than that
    of its words counted one by one, those that aren't in idf with the least weight they can have, rare.  Of runs that
    pass, the words are then counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i + 1 for i, t in enumerate(idf)}
        value = np.zeros((len(at) + 1, len(known)))
        for j, b in enumerate(known.values()):
            size = math.sqrt(sum(x * x for x in b.values()))
            for t, x in b.items():
                value[at[t], j] = x * idf[t] / size
        square, need = np.array([rare * rare, *(x * x for x in idf.values())]), np.array(needs) - 1e-6
        term = re.compile(TERM)
        for batch in batches:
            out: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [term.findall(x) for x in text.lower().split("\n")]
                ends = np.r_[0, np.cumsum([len(x) for x in lines])]
                if not ends[-1]:
                    continue
                flat = np.fromiter((at.get(t, 0) for x in lines for t in x), np.int64, ends[-1])
                dot = np.r_[np.zeros((1, len(known))), np.cumsum(value[flat], axis=0)][ends]
                norm = np.r_[0.0, np.cumsum(square[flat])][ends]
                breaks = [-1, *(i for i, x in enumerate(lines) if not x), len(lines)]
                spans = {(a + 1, b) for a, b in zip(breaks, breaks[1:], strict=False) if b > a + 1} | {(0, len(lines))}
                spans |= {(i, i + w) for w in range(1, RUN_LINES + 1) for i in range(len(lines) - w + 1)}
                pairs = np.array(sorted(spans))
                size = np.sqrt(np.maximum(norm[pairs[:, 1]] - norm[pairs[:, 0]], 1e-9))
                may = (dot[pairs[:, 1]] - dot[pairs[:, 0]] >= need * size[:, None]).any(1)
                if not may.any():
                    continue
                names: dict[str, int] = {}
                local = np.fromiter((names.setdefault(t, len(names)) for x in lines for t in x), np.int64, ends[-1])
                weight = np.array([idf.get(t, rare) for t in names])
                for a, b in pairs[may].tolist():
                    own, tf = np.unique(local[ends[a] : ends[b]], return_counts=True)
                    if len(own) and (dot[b] - dot[a] >= need * math.sqrt(((tf * weight[own]) ** 2).sum())).any():
                        out.append((path, a * 1_000_000_000 + b, int(ends[-1]), [t for x in lines[a:b] for t in x]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["path", "line", "n_all", "terms"])

    return files.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text").mapInArrow(run, "path string, line long, n_all long, terms array<string>")


def own_licences(files: DataFrame, *, least: float = 0.5) -> DataFrame:
    """path, licence, score, share (of the file's words in lines that name a licence) of files that have one."""
    spark = files.sparkSession
    use_shared_dir(spark)
    named = files.where(F.col("text").rlike(NAMES_LICENCE) & F.col("path").isNotNull()).select("path", "text")
    lines = named.select("path", F.size(terms_of(F.col("text"))).alias("n_all"), F.posexplode(F.split("text", "\n")).alias("line", "body")).where(F.col("body").rlike(NAMES_LICENCE))
    sections = lines.select("path", "line", "n_all", terms_of(F.col("body")).alias("terms")).where(F.size("terms") > 0).dropDuplicates(["path", "line", "terms"]).checkpoint()
    tf = sections.select("path", "line", F.explode("terms").alias("term")).groupBy("path", "line", "term").agg(F.count("*").alias("tf"))
    fixed = spark.createDataFrame(sorted(TEMPLATES.items()), "licence string, body string").select("licence", F.explode(terms_of(F.col("body"))).alias("term"))
    fixed_tf = fixed.groupBy("licence", "term").agg(F.count("*").alias("tf"))
    df = tf.select("term").union(fixed_tf.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    n, total = sections.agg(F.count("*"), F.coalesce(F.sum(F.size(F.array_distinct("terms"))), F.lit(0))).first()
    n += len(TEMPLATES)
    idf = df.select("term", "df", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")).checkpoint()
    # terms of so many lines are at most FREQUENT and the templates' own, which bounds what comes to the driver
    often = max(2, -(-total // FREQUENT))
    # the templates' terms are a fixed list, so what comes to the driver is bounded
    bodies = {f"{k}#{i}": (k, collections.Counter(re.findall(TERM, body.lower()))) for i, (k, body) in enumerate([*TEMPLATES.items(), *WHOLE])}
    terms = sorted({t for _, c in bodies.values() for t in c})
    held = spark.createDataFrame([(t,) for t in terms], "term string")
    weight = {t: math.log(n + 1.0) + 1.0 for t in terms} | {r["term"]: r["idf"] for r in idf.join(F.broadcast(held), "term").collect()}
    frequent = weight | {r["term"]: r["idf"] for r in idf.where(F.col("df") >= often).select("term", "idf").collect()}
    vectors = {name: {t: k * weight[t] for t, k in c.items()} for name, (_, c) in bodies.items()}
    need = {name: least if i < len(TEMPLATES) else max(least, WHOLE_LEAST) for i, name in enumerate(bodies)}
    known = spark.createDataFrame([(name, bodies[name][0], t, x, math.sqrt(sum(y * y for y in v.values())), need[name]) for name, v in vectors.items() for t, x in v.items()], "name string, licence string, term string, b double, norm_b double, need double")
    runs = _runs(files, vectors, list(need.values()), frequent, math.log((n + 1.0) / often) + 1.0).dropDuplicates(["path", "line", "terms"]).checkpoint()
    # document frequencies are of the lines that name a licence and the short forms; no other term has any
    run_tf = runs.select("path", "line", F.explode("terms").alias("term")).groupBy("path", "line", "term").agg(F.count("*").alias("tf"))
    weighed = run_tf.join(idf, "term", "left").select("path", "line", "term", (F.col("tf") * F.coalesce("idf", F.lit(math.log(n + 1.0) + 1.0))).alias("a"))
    norm = weighed.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm_a"))
    dots = weighed.join(F.broadcast(known), "term").groupBy("path", "line", "name", "licence", "norm_b", "need").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    scored = dots.join(norm, ["path", "line"]).select("path", "line", "licence", "need", F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), 9).alias("score"))
    sized = scored.where(F.col("score") >= F.col("need")).join(runs.select("path", "line", (F.size("terms") / F.col("n_all")).alias("share")), ["path", "line"]).select("path", "licence", "score", "share")
    ids = F.create_map(*(F.lit(x) for k in SPDX_IDS.items() for x in k))
    marked = files.where(F.col("path").isNotNull()).select("path", F.element_at(ids, F.lower(F.regexp_extract("text", SPDX, 1))).alias("licence"), F.lit(1.0).alias("score"), F.lit(0.0).alias("share")).where(F.col("licence").isNotNull())
    best = sized.union(marked).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"), F.max("share").alias("run_share"))
    share = sections.groupBy("path").agg((F.sum(F.size("terms")) / F.max("n_all")).alias("share"))
    return best.join(share, "path", "left").select("path", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"), F.greatest(F.coalesce("share", F.lit(0.0)), "run_share").alias("share"))


def scan_licences(files: DataFrame, *, least: float = 0.5, file_share: float = 0.5) -> DataFrame:
    """path, own_licence, score, licence, found_by (own, directory or null) and from_path for every row of files(path, text)."""
    own = own_licences(files, least=least)
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE) | (F.col("share") >= file_share)
    giving = own.where(is_file).select(directory_of(F.col("path")).alias("dir"), F.struct((-F.col("score")).alias("s"), F.col("path"), "licence").alias("g"))
    given = giving.groupBy("dir").agg(F.min("g").alias("g")).select("dir", F.col("g.licence").alias("d_licence"), F.col("g.path").alias("d_path"))
    paths = files.select("path").where(F.col("path").isNotNull())
    dirs = paths.select(directory_of(F.col("path")).alias("at")).distinct()
    parts = F.split("at", "/")
    above = dirs.select("at", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    named = above.select("at", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("at", "/"), F.lit(1), F.greatest("depth", F.lit(1))), "/")).alias("dir"))
    near = (
        named.where((F.col("depth") == 0) | (F.col("dir") != "")).join(given, "dir")
        .groupBy("at").agg(F.max_by(F.struct("d_licence", "d_path"), "depth").alias("n"))
        .select("at", F.col("n.d_licence").alias("d_licence"), F.col("n.d_path").alias("d_path"))
    )
    held = own.select("path", F.col("licence").alias("own_licence"), "score")
    every = files.select("path").withColumn("at", directory_of(F.col("path")))
    return every.join(held, "path", "left").join(near, "at", "left").select(
        "path", "own_licence", "score", F.coalesce("own_licence", "d_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").when(F.col("d_licence").isNotNull(), "directory").alias("found_by"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("d_path")).alias("from_path"),
    )

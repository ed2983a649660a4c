"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's notices (lines that speak of a licence) and the whole text of licence files become
sparse term vectors; only their terms are exploded and joined with the terms of the templates,
a table of fixed size. A directory has the licence of its best licence file. Directories look
up their ancestors by joins on paths, each directory once, and files join their directory.
Weights are whole numbers, so that sums do not depend on their order. Built-in functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written

# The usual notices of public licences, by their SPDX names.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: A line is a notice if it holds one of these.
NOTICE = "[Ll]icen[cs]e|LICEN[CS]E|[Pp]ermission is hereby granted|[Pp]ermission to use|[Pp]ublic domain|[Rr]edistribution and use"
LICENSE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
TERM = "[a-z0-9]+"
SCALE = 1000


def template_weights(templates=TEMPLATES) -> tuple[dict[str, int], int, list[tuple[int, str, str, int]], dict[int, int]]:
    """(weight by term, weight of other terms, (template, name, term, tf * weight), squared norms)."""
    bags = []
    for name, text in templates:
        terms = re.findall(TERM, text.lower())
        bags.append((name, {t: terms.count(t) for t in dict.fromkeys(terms)}))
    holding: dict[str, int] = {}
    for _, bag in bags:
        for t in bag:
            holding[t] = holding.get(t, 0) + 1
    weight = lambda n: round(SCALE * (math.log((1 + len(bags)) / (1 + n)) + 1))
    idf = {t: weight(n) for t, n in holding.items()}
    rows = [(i, name, t, n * idf[t]) for i, (name, bag) in enumerate(bags) for t, n in bag.items()]
    norms: dict[int, int] = {}
    for i, _, _, w in rows:
        norms[i] = norms.get(i, 0) + w * w
    return idf, weight(0), rows, norms


def _notices(files: DataFrame) -> DataFrame:
    """(file, part, body): each notice of a file, and part 0 for the whole text of licence files."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("part"), x.alias("body"))), lambda s: s["body"].rlike(NOTICE))
    whole = F.when(F.col("is_license"), F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("body")))).otherwise(F.array().cast("array<struct<part:int,body:string>>"))
    some = files.where(F.col("text").rlike(NOTICE) | F.col("is_license"))
    return some.select("path", F.explode(F.concat(whole, lines)).alias("x")).select("path", "x.part", "x.body")


def scan_licenses(files: DataFrame, *, license_file: Column | None = None, templates=TEMPLATES, least: int = 6000) -> DataFrame:
    """The licence of each file of ``files`` (path, text): its own, or that of its nearest directory.

    ``license_file`` tells licence files (default: by name); ``least`` is the smallest cosine in
    ten-thousandths. Returns path, own_license, score (of the best notice, null without),
    license (own, else inherited), license_dir (where it is inherited from, else null).

    Of equal scores the earlier template and part win; of the licence files of a directory the
    best score, then the smallest path. A null text has no notice. A file without a path is
    scanned but neither gives nor inherits. Rows that share a path share the best score of them.
    Other columns are left out; an empty table gives no rows."""
    spark = files.sparkSession
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)) if license_file is None else F.coalesce(license_file, F.lit(False))
    slim = files.select(F.col("path").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), named.alias("is_license"))
    idf, other, rows, norms = template_weights(templates)
    terms = spark.createDataFrame([(i, n, t, w, norms[i]) for i, n, t, w in rows], "template int, name string, term string, weight long, squared long")
    weights = spark.createDataFrame(list(idf.items()), "term string, idf long")
    # both tables have the terms of the templates only, a fixed size, whatever the input
    bag = _notices(slim).select("path", "part", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(f"({TERM})"))).alias("term"))
    bag = written(bag.groupBy("path", "part", "term").agg(F.count("*").alias("tf")), "bag")  # read for lengths and for products
    bag = bag.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    length = bag.groupBy("path", "part").agg(F.sum(F.col("w") * F.col("w")).alias("own_squared"))
    dots = bag.join(F.broadcast(terms), "term").groupBy("path", "part", "template", "name", "squared").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = F.col("l.path").eqNullSafe(F.col("d.path")) & (F.col("l.part") == F.col("d.part"))
    cosine = F.floor(10000 * F.col("dot") / (F.sqrt("own_squared") * F.sqrt("squared"))).cast("long")
    scored = dots.alias("d").join(length.alias("l"), same).select("d.path", "d.part", "template", "name", cosine.alias("score"))
    best = scored.groupBy("path").agg(F.max(F.struct("score", -F.col("template"), -F.col("part"), "name")).alias("b")).select("path", "b.score", "b.name")
    own = slim.select("path", "is_license").alias("f").join(best.alias("b"), F.col("f.path").eqNullSafe(F.col("b.path")), "left")
    own = own.select("f.path", "is_license", "score", F.when(F.col("score") >= least, F.col("name")).alias("own_license"), F.regexp_replace("f.path", "/?[^/]*$", "").alias("dir"))
    own = written(own, "own")
    given = own.where("is_license and own_license is not null and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own_license")).alias("g")).select("dir", F.col("g.own_license").alias("given"))
    # every directory with its ancestors, itself included; the longest that has a licence
    dirs = own.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    pairs = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    near = pairs.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("x")).select("dir", "x.above", "x.given")
    # written, so that the files of a full directory come straight from a shuffle and can be split over tasks
    out = own.join(written(near, "near"), "dir", "left")
    return out.select("path", "own_license", "score", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("above")).alias("license_dir"))


#: How the documents of the test tables lie in directories: by source, then by runs of ids; the first
#: of a run of 1000 lies in the source's directory, the first of a run of 50 in that of its 1000.
DOCUMENT_DIR = "concat(coalesce(source, 'none'), if(doc_id % 1000 = 0, '', concat('/d', doc_id div 1000)), if(doc_id % 50 = 0, '', concat('/p', doc_id div 50)))"


def document_licenses(docs: DataFrame) -> DataFrame:
    """``scan_licenses`` of documents, each a file of its source's tree; one with a notice is a
    licence file of its directory. Returns doc_id besides.

    A null id makes a null directory: such a document is scanned, but neither gives nor inherits.
    A null source is one of its own; rows with the same id and source are one file, each gets its
    result; very long texts count whole; other columns are left out; no documents give no rows."""
    files = docs.select(F.concat(F.expr(DOCUMENT_DIR), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias("path"), F.col("text").cast("string").alias("text"))
    out = scan_licenses(files, license_file=F.col("text").rlike(NOTICE))
    return out.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "path", "own_license", "score", "license", "license_dir")


def oracle(least: int = 6000, templates=TEMPLATES) -> str:
    """``document_licenses`` as DuckDB SQL."""
    idf, other, rows, norms = template_weights(templates)
    weights = ", ".join(f"('{t}', {w})" for t, w in idf.items())
    terms = ", ".join(f"({i}, '{n}', '{t}', {w}, {norms[i]})" for i, n, t, w in rows)
    return f"""
WITH f AS (SELECT doc_id, coalesce(source, 'none') || CASE WHEN doc_id % 1000 = 0 THEN '' ELSE '/d' || doc_id // 1000 END || CASE WHEN doc_id % 50 = 0 THEN '' ELSE '/p' || doc_id // 50 END AS dir, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, dir, dir || '/' || doc_id AS path, text, regexp_matches(text, '{NOTICE}') AS lic FROM f),
s AS (SELECT doc_id, 0 AS part, text AS body FROM n WHERE lic
  UNION ALL SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM n WHERE lic)
  WHERE regexp_matches(line, '{NOTICE}')),
b AS (SELECT doc_id, part, term, count(*) AS tf FROM (SELECT doc_id, part, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM s) GROUP BY ALL),
w AS (SELECT doc_id, part, b.term, tf * coalesce(idf, {other}) AS w FROM b LEFT JOIN (VALUES {weights}) v(term, idf) ON b.term = v.term),
l AS (SELECT doc_id, part, sum(w * w) AS sq FROM w GROUP BY ALL),
d AS (SELECT doc_id, part, template, name, squared, sum(w * weight) AS dot FROM w JOIN (VALUES {terms}) t(template, name, term, weight, squared) ON w.term = t.term GROUP BY ALL),
c AS (SELECT doc_id, part, template, name, CAST(floor(10000 * CAST(dot AS DOUBLE) / (sqrt(CAST(sq AS DOUBLE)) * sqrt(CAST(squared AS DOUBLE)))) AS BIGINT) AS score FROM d JOIN l USING (doc_id, part)),
o AS (SELECT doc_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template, part) AS r FROM c) WHERE r = 1),
x AS (SELECT n.doc_id, dir, path, lic, score, CASE WHEN score >= {least} THEN name END AS own FROM n LEFT JOIN o USING (doc_id)),
g AS (SELECT dir, own AS given FROM (SELECT dir, own, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS r FROM x WHERE lic AND own IS NOT NULL) WHERE r = 1),
a AS (SELECT x.doc_id, g.dir AS above, g.given, row_number() OVER (PARTITION BY x.doc_id ORDER BY length(g.dir) DESC) AS r FROM x JOIN g ON x.dir = g.dir OR starts_with(x.dir, g.dir || '/'))
SELECT x.doc_id, path, own AS own_license, score, coalesce(own, given) AS license, CASE WHEN own IS NULL THEN above END AS license_dir
FROM x LEFT JOIN a ON x.doc_id = a.doc_id AND a.r = 1"""

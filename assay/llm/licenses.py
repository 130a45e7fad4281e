"""Licences of documents: their own notices, or those of the nearest directory above.

Templates are the full texts in ``templates/``, and notices as files begin with
them, SPDX tags among these. Units are whole documents and windows of lines
around each line with a word that licences use, as notices are often wrapped.
Units and templates are sparse TF-IDF vectors, with inverse document
frequencies over the templates (a fixed table, so it is broadcast). A window
goes to the notice with the largest cosine, if that is at least ``LEAST``; a
whole document goes to the full text, if that is at least ``FILE``, so that it
must have nearly all of it and little else. Such a document, or one with a
notice that is named like a licence file, covers its directory. Documents
without a licence of their own inherit from the nearest directory above them
that has one; that is resolved once per directory, by joins of its ancestors'
paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, documents

# Notices as files commonly carry them.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright and dedicated this work to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# SPDX identifiers that don't equal the licence's name here.
SPDX = {"GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"]}
ANCHOR = "[Ll][Ii][Cc][Ee][Nn][CcSs]|[Cc]opyright|SPDX|[Pp]ublic [Dd]omain|Redistribution and use|Permission (is hereby|to use)"
FILE_NAME = "(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$"
#: Where a window begins, from its line with a word that licences use, and how many lines it has.
WINDOWS = [(0, 1), (0, 2), (-1, 3), (-1, 4), (0, 4)]
LEAST, FILE, TERM = 0.6, 0.75, "[^a-z0-9]+"


@cache
def templates() -> list[tuple[str, bool, str]]:
    """(licence, whether it is a full text, text)."""
    whole = [(x.name.removesuffix(".txt"), True, x.read_text(encoding="utf-8")) for x in sorted(files("assay.llm").joinpath("templates").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")]
    names = sorted({x for x, *_ in whole} | {x for x, _ in NOTICES})
    tags = [(name, False, f"SPDX-License-Identifier: {x}") for name in names for x in [name, *SPDX.get(name, [])]]
    return [*whole, *[(x, False, text) for x, text in NOTICES], *tags]


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(TERM, text.lower()) if t]


@cache
def vectors() -> tuple[dict[str, float], list[dict[str, float]], float]:
    """Inverse document frequencies, each template's unit vector, and the frequency of terms that no template has. A term that comes n times weighs 1 + ln n."""
    counts = [Counter(terms_of(t)) for *_, t in templates()]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for c in counts:
        weights = {t: (1 + math.log(n)) * idf[t] for t, n in sorted(c.items())}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append({t: w / norm for t, w in weights.items()})
    return idf, out, math.log(1 + len(counts)) + 1


def _weights(spark: SparkSession) -> DataFrame:
    """(term, idf, weights): a few thousand rows, by the templates alone."""
    idf, units, _ = vectors()
    return spark.createDataFrame([(t, i, [u.get(t, 0.0) for u in units]) for t, i in sorted(idf.items())], "term string, idf double, weights array<double>")


def matches(df: DataFrame, keys: list[str], least: float = LEAST, file: float = FILE) -> DataFrame:
    """``df`` (text and ``keys``) to (keys, line, license, score) of the units that match; line is -1 for whole documents."""
    some = df.where(F.col("text").rlike(ANCHOR)).withColumn("row", F.monotonically_increasing_id()).withColumn("lines", F.split("text", "\n"))
    line = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(ANCHOR))

    def windows(i: Column) -> Column:
        ends = F.array(*[F.struct(F.greatest(i + at, F.lit(0)).alias("from"), F.least(i + (at + n), F.size("lines")).alias("to")) for at, n in WINDOWS])
        return F.transform(F.array_distinct(ends), lambda w, k: F.struct(i.alias("line"), k.alias("window"), F.array_join(F.slice("lines", w["from"] + 1, w["to"] - w["from"]), "\n").alias("unit")))

    whole = F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("window"), F.col("text").alias("unit")))
    units = some.select(*keys, "row", F.explode(F.concat(whole, F.flatten(F.transform(line, windows)))).alias("u")).select(*keys, "row", "u.*")
    terms = units.select(*keys, "row", "line", "window", F.explode(F.split(F.lower("unit"), TERM)).alias("term")).where("term <> ''")
    by = [*keys, "row", "line", "window"]
    counted = terms.groupBy(*by, "term").agg(F.count("*").alias("n"))
    weighed = counted.join(F.broadcast(_weights(df.sparkSession)), "term", "left")
    weight = (F.log("n") + 1) * F.coalesce(F.col("idf"), F.lit(vectors()[2]))
    sums = [F.sum(F.coalesce(weight * F.col("weights")[i], F.lit(0.0))).alias(f"t{i}") for i in range(len(templates()))]
    found = weighed.groupBy(*by).agg(F.sqrt(F.sum(weight * weight)).alias("norm"), *sums)

    def top(full: bool) -> Column:
        # rounded, as sums depend on the order of their terms
        return F.array_max(F.array(*[F.struct(F.round(F.col(f"t{i}") / F.col("norm"), 6).alias("score"), F.lit(name).alias("license")) for i, (name, whole, _) in enumerate(templates()) if whole == full]))

    found = found.select(*by, F.when(F.col("line") < 0, top(True)).otherwise(top(False)).alias("top"))
    return found.select(*keys, "line", "top.license", "top.score").where(F.col("score") >= F.when(F.col("line") < 0, file).otherwise(least))


def scan_licenses(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, file: float = FILE) -> DataFrame:
    """doc_id, path, kind ('file', 'header', 'inherited' or null), license, score, line
    (-1 without a header) and from_dir for each row.

    A document that is a full text is a file; one that has notices has the
    licence of the one with the largest score, then the last licence by name,
    then the first line, and is a file if it is named like one. Own licences go
    before inherited ones; a directory with several files takes the one with
    the largest score, then licence, then path. Null and empty texts have no
    licence of their own; very long ones are read to the end. Rows with a null
    path inherit nothing and cover nothing; rows equal in id, path and text each
    come out with the same result. No rows give none. Columns other than those
    named are not read, so their names cannot clash.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{id_col}`").alias("doc_id"), path.cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blank = F.col("id").isNull().cast("int") + F.col("path").isNull().cast("int") * 2 + F.col("text").isNull().cast("int") * 4
    keys = ["h0", "h1"]
    docs = docs.select("doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "text", *[F.xxhash64(F.lit(k), blank, F.octet_length("id"), "id", F.octet_length("path"), "path", "text").alias(f"h{k}") for k in range(2)])
    hits = matches(docs.select(*keys, "text"), keys, least, file)
    header = F.max(F.when(F.col("line") >= 0, F.struct("score", "license", (-F.col("line")).alias("back")))).alias("header")
    own = cut(hits.groupBy(*keys).agg(header, F.max(F.when(F.col("line") < 0, F.struct("score", "license"))).alias("file")), "own")
    named = F.col("header").isNotNull() & F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME)
    kind = F.when(F.col("file").isNotNull() | named, "file").when(F.col("header").isNotNull(), "header")
    docs = docs.drop("text").join(own, keys, "left").select("doc_id", "path", "dir", kind.alias("kind"), F.coalesce("file.license", "header.license").alias("license"), F.coalesce("file.score", "header.score").alias("score"), (-F.col("header.back")).alias("line"))
    docs = cut(docs, "licensed")

    licensed = docs.where("kind = 'file' and path is not null").groupBy(F.col("dir").alias("at")).agg(F.max(F.struct("score", "license", "path")).alias("x")).select("at", F.col("x.license").alias("given"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    above = docs.where("kind is null and path is not null").select("dir").distinct().select("dir", F.explode(ups).alias("up")).select("dir", "up.depth", "up.at")
    near = above.join(licensed, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "given")).alias("x")).select(F.col("dir").alias("of_dir"), F.col("x.at").alias("from_dir"), F.col("x.given").alias("given"))
    near = cut(near, "directories")  # a table of its own, so that Spark can split large directories in the join
    out = docs.join(near, F.col("kind").isNull() & (F.col("dir") == F.col("of_dir")), "left")
    return out.select("doc_id", "path", F.coalesce("kind", F.when(F.col("given").isNotNull(), "inherited")).alias("kind"), F.coalesce("license", "given").alias("license"), "score", F.coalesce(F.col("line").cast("int"), F.lit(-1)).alias("line"), "from_dir")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's directory is its source, language and the leading digits of its id: 1234 is src/en/1/2/3/4, below what 12 covers."""
    docs = documents(spark, sf_dir)
    return scan_licenses(docs, F.concat_ws("/", "source", "lang", F.array_join(F.split(F.col("doc_id").cast("string"), ""), "/")))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {whole}, {quoted(text)})" for i, (name, whole, text) in enumerate(templates()))
    windows = ", ".join(f"({at}, {n})" for at, n in WINDOWS)
    return f"""
WITH RECURSIVE templates(i, license, whole, body) AS (VALUES {rows}),
counted AS (SELECT i, term, 1 + ln(count(*)) AS tf FROM (SELECT i, unnest(regexp_split_to_array(lower(body), '{TERM}')) AS term FROM templates) WHERE term <> '' GROUP BY i, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM counted GROUP BY term),
weights AS (SELECT i, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY i)) AS w FROM counted JOIN idf USING (term)),
docs AS (SELECT doc_id, text, concat_ws('/', source, lang, array_to_string(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), '/')) AS path FROM documents),
placed AS (SELECT doc_id, text, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM docs),
lined AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs WHERE regexp_matches(text, '{ANCHOR}')),
anchors AS (SELECT doc_id, lines, line FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS line FROM lined) WHERE regexp_matches(lines[line + 1], '{ANCHOR}')),
windows(shift, n) AS (VALUES {windows}),
units AS (SELECT doc_id, line, greatest(line + shift, 0) AS b, least(line + shift + n, len(lines)) AS e, array_to_string(lines[greatest(line + shift, 0) + 1:least(line + shift + n, len(lines))], chr(10)) AS unit FROM anchors, windows
          UNION ALL SELECT doc_id, -1, 0, 0, text FROM docs WHERE regexp_matches(text, '{ANCHOR}')),
terms AS (SELECT doc_id, line, b, e, term, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, line, b, e, unnest(regexp_split_to_array(lower(unit), '{TERM}')) AS term FROM (SELECT DISTINCT * FROM units)) WHERE term <> '' GROUP BY ALL),
norms AS (SELECT doc_id, line, b, e, sqrt(sum((tf * coalesce(idf, ln(1 + (SELECT count(*) FROM templates)) + 1)) ** 2)) AS norm FROM terms LEFT JOIN idf USING (term) GROUP BY ALL),
dots AS (SELECT doc_id, line, b, e, i, sum(tf * idf * w) AS dot FROM terms JOIN idf USING (term) JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, line, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, line, b, e) JOIN templates USING (i) WHERE whole = (line < 0)),
hits AS (SELECT * FROM scored WHERE score >= CASE WHEN line < 0 THEN {FILE} ELSE {LEAST} END),
own AS (SELECT doc_id, max(struct_pack(score := score, license := license, back := -line)) FILTER (line >= 0) AS header, max(struct_pack(score := score, license := license)) FILTER (line < 0) AS file FROM hits GROUP BY doc_id),
mine AS (SELECT d.doc_id, path, dir, CASE WHEN file IS NOT NULL OR header IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '{FILE_NAME}') THEN 'file' WHEN header IS NOT NULL THEN 'header' END AS kind,
         coalesce(file.license, header.license) AS license, coalesce(file.score, header.score) AS score, -header.back AS line FROM placed d LEFT JOIN own o ON d.doc_id = o.doc_id),
licensed AS (SELECT dir AS place, max(struct_pack(score := score, license := license, path := path)).license AS given FROM mine WHERE kind = 'file' GROUP BY dir),
above AS (SELECT DISTINCT dir, dir AS place FROM mine WHERE kind IS NULL
          UNION ALL SELECT dir, regexp_replace(place, '/?[^/]*$', '') FROM above WHERE place <> ''),
near AS (SELECT dir, arg_max(place, length(place)) AS from_dir, arg_max(given, length(place)) AS given FROM above JOIN licensed USING (place) GROUP BY dir)
SELECT doc_id, path, coalesce(kind, CASE WHEN given IS NOT NULL THEN 'inherited' END) AS kind, coalesce(license, given) AS license, score,
  CAST(coalesce(line, -1) AS INTEGER) AS line, CASE WHEN kind IS NULL THEN from_dir END AS from_dir
FROM mine LEFT JOIN near ON mine.dir = near.dir AND mine.kind IS NULL
"""


SQL = {"op9_licenses": _sql()}

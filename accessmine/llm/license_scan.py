"""License statements in texts, by MinHash bands over overlapping windows of word shingles.

Only DataFrame functions run here. A window of eight shingles begins at every fourth, so
five shingles in a row lie in one window; templates are cut into pieces of that size at
most. A piece of three within a window has a Jaccard similarity of 3/8, and with 32 bands
of one coordinate it is missed with a chance of 3e-7, one of which three of five are there
with 1e-5. Only the exact count of common shingles decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accessmine.llm.common import LOWER, UPPER, lowered, stored

#: A word without the punctuation at its edges; what is nothing but punctuation is no word.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}](?:[^\x20\x09-\x0D]*[0-9A-Za-z\x{80}-\x{10FFFF}])?"
#: Statements and whole headers to find, fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
SHINGLE, WINDOW, STRIDE, PIECE, BANDS = 3, 8, 4, 5, 32
LEAST = 0.8


def _joined(words: Column, i: Column) -> Column:
    parts = [F.element_at(words, (i + k + 1).cast("int")) for k in range(SHINGLE)]
    return F.concat_ws(" ", *parts)


def _ranked(band: int):
    return lambda s: F.struct(F.xxhash64(F.lit(band), s).alias("h"), s.alias("s"))


def pieces(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, piece, shingles): a template's shingles in pieces of even size."""
    rows = []
    for name, text in templates.items():
        words = re.findall(TOKEN.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), text.translate(str.maketrans(UPPER, LOWER)))
        own = list(dict.fromkeys(" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)))
        parts = -(-len(own) // PIECE)
        for p in range(parts):
            rows.append((name, p, own[p * len(own) // parts : (p + 1) * len(own) // parts]))
    return spark.createDataFrame(rows, "template string, piece int, part array<string>")


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, template, matched, containment) of statements that texts contain.

    Words go without the punctuation at their edges, so neither a full stop nor a line break
    matters. A piece counts with the most of its shingles that one window holds; a statement is
    found if at least ``least`` of its shingles count. Null and short texts contain
    nothing; rows that repeat a doc_id and its text give one result; a null doc_id stays
    null; texts of any length go whole; other columns, whatever their names, are not read;
    an empty table gives an empty result.

    A window can share a coordinate with a piece only if it holds the shingle that gives
    the piece's value, so signatures are worked out only for windows that hold one of these.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    own = pieces(spark, templates)
    lowest = [F.array_min(F.transform("part", _ranked(b))) for b in range(BANDS)]
    signed = own.select("template", "piece", F.posexplode(F.array(*lowest)).alias("band", "low")).select("template", "piece", "band", "low.h", "low.s")
    # as many values as bands and pieces at most, for any number of documents
    keys = sorted(r["s"] for r in signed.select("s").distinct().collect())
    starts = sorted({k.split(" ")[0] for k in keys})
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(TOKEN), F.lit(0))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), words.alias("w"))
    # places whose first word begins a wanted shingle (the outer form keeps the words from being cut twice), then those that hold one
    begins = F.filter(F.transform("w", lambda x, i: F.when(x.isin(starts), i)), lambda i: i.isNotNull() & (i <= F.size("w") - SHINGLE))
    spots = rows.select("doc_id", "_key", "w", F.explode_outer(begins).alias("p")).where("p is not null").where(_joined(F.col("w"), F.col("p")).isin(keys))
    spots = spots.select("doc_id", "_key", "w", F.explode(F.array(F.floor(F.col("p") / STRIDE), F.floor(F.col("p") / STRIDE) - 1)).alias("at")).where("at >= 0")
    last = F.least(F.col("at") * STRIDE + WINDOW, (F.size("w") - SHINGLE + 1).cast("long")) - 1
    held = spots.select("doc_id", "_key", "at", "w", F.explode(F.sequence(F.col("at") * STRIDE, last)).alias("i"))
    held = stored(held.select("doc_id", "_key", "at", _joined(F.col("w"), F.col("i")).alias("s")).distinct(), "windows")
    signature = held.groupBy("doc_id", "_key", "at").agg(*[F.min(F.xxhash64(F.lit(b), "s")).alias(f"m{b}") for b in range(BANDS)])
    bands = signature.select("doc_id", "_key", "at", F.posexplode(F.array(*[f"m{b}" for b in range(BANDS)])).alias("band", "h"))
    met = bands.join(F.broadcast(signed.select("template", "piece", "band", "h")), ["band", "h"]).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("at").alias("_at"), "template", "piece").distinct()
    parts = own.select("template", "piece", F.explode("part").alias("s"))
    both = held.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")) & (F.col("at") == F.col("_at")))
    count = both.join(F.broadcast(parts), ["template", "piece", "s"]).groupBy("doc_id", "_key", "at", "template", "piece").agg(F.count(F.lit(1)).alias("n"))
    best = count.groupBy("doc_id", "_key", "template", "piece").agg(F.max("n").alias("n"))
    total = own.groupBy("template").agg(F.sum(F.size("part")).alias("total"))
    out = best.groupBy("doc_id", "_key", "template").agg(F.sum("n").alias("matched")).join(F.broadcast(total), "template")
    out = out.withColumn("containment", F.col("matched") / F.col("total")).where(F.col("containment") >= least)
    return out.select("doc_id", "template", F.col("matched").cast("long").alias("matched"), F.round("containment", 6).alias("containment"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same over all windows, in SQL."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in templates.items())
    norm = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = lambda src: f"regexp_extract_all({src}, '{TOKEN}')"
    return f"""
    WITH t(template, text) AS (VALUES {quoted}),
    tw AS (SELECT template, {cut(norm)} AS w FROM t),
    tg AS (SELECT template, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s, min(i) AS i FROM tw, unnest(range(1, len(w) - 1)) AS u(i) GROUP BY ALL),
    ts AS (SELECT template, s, row_number() OVER (PARTITION BY template ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY template) AS n FROM tg),
    tp AS (SELECT template, s, n, (SELECT max(p) FROM range(0, CAST(ceil(n / {PIECE}.0) AS BIGINT)) AS r(p) WHERE (p * n) // CAST(ceil(n / {PIECE}.0) AS BIGINT) <= k) AS piece FROM ts),
    dw AS (SELECT DISTINCT doc_id, text, {cut(norm)} AS w FROM documents),
    ds AS (SELECT doc_id, text, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s, i - 1 AS pos FROM dw, unnest(range(1, len(w) - 1)) AS u(i)),
    hit AS (SELECT doc_id, text, template, n, piece, ds.s, a.win FROM ds JOIN tp ON tp.s = ds.s, unnest([pos // {STRIDE}, pos // {STRIDE} - 1]) AS a(win) WHERE a.win >= 0),
    best AS (SELECT doc_id, text, template, n, piece, max(c) AS c FROM (SELECT doc_id, text, template, n, piece, win, count(DISTINCT s) AS c FROM hit GROUP BY doc_id, text, template, n, piece, win) GROUP BY doc_id, text, template, n, piece)
    SELECT doc_id, template, CAST(sum(c) AS BIGINT) AS matched, round(sum(c) / n::DOUBLE, 6) AS containment FROM best GROUP BY doc_id, text, template, n HAVING sum(c) / n::DOUBLE >= {least}"""

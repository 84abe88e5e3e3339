"""License notices by MinHash bands over text windows, in DataFrame and SQL functions only.

Words are runs of letters and digits in lower case; a shingle is five words.
Text windows of ``c`` shingles overlap by half.  A window's signature is, for
each band, the smallest of its shingles' hashes under the band's seed; a
window and a template window meet when a band agrees, which happens with
probability 1 - (1 - J) ** bands for Jaccard J: 0.998 at J = 0.8 and four
bands, and always for equal windows.  Templates are windowed at every offset,
so an intact run of c + c / 2 - 1 shingles always meets.  Templates of eight
shingles or more use c = 4; at a containment of 0.8 a whole edited word costs
five shingles, so such a run is always left.  Shorter templates use c = 1,
where the signature is the shingle.

A band that agrees is a shingle in common, so only windows are signed in which
the first, middle and last word of some shingle are templates' words; nothing
is lost.  Bands alone say which windows go on: those whose signature is one of
the templates'.  They meet the templates in a join by band and signature, with
the stretch of words around the window.  Templates are the caller's to list: a
dictionary whose words and signatures are part of the plan, some thousands at
most.

Candidates are then verified: the share of the template's shingles that lie
in a window of as many shingles must reach ``containment``.  Only matches are
shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public notice texts, fixed values.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-conditions": "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
WIDTH, WIDE, BANDS = 5, 4, 4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _shingle(hashes: Column, i: Column) -> Column:
    """64-bit hash of the run of five words from word i on, given the words' hashes."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)])


def _starts(hashes: Column) -> Column:
    """Word numbers at which a shingle starts; none for fewer than five words."""
    n = F.size(hashes)
    return F.when(n >= WIDTH, F.sequence(F.lit(0), F.greatest(n, F.lit(WIDTH)) - WIDTH)).otherwise(F.array().cast("array<int>"))


def _band(window: Column, seed: int) -> Column:
    return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(seed))))


def _once(value: Column) -> Column:
    """A generator of exactly one row: what stands above reads the computed value.

    Without it the optimiser may copy the expression into a filter or into
    every step of a lambda.
    """
    return F.explode(F.array(value))


def _templates(spark, templates: dict[str, str]) -> tuple[list[dict], set[int]]:
    """Shingles and window signatures of the templates, computed like the documents', and their words' hashes."""
    rows = spark.createDataFrame(list(templates.items()), "template string, text string").select("template", _once(word_hashes(words(F.col("text")))).alias("w"))
    rows = rows.select("template", "w", _once(F.transform(_starts(F.col("w")), lambda i: _shingle(F.col("w"), i))).alias("h"))
    windows = F.when(F.size("h") >= WIDE, F.transform(F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(WIDE)) - WIDE + 1), lambda i: F.array(*[_band(F.slice("h", i, WIDE), s) for s in range(BANDS)])))
    out = [r.asDict() for r in rows.select("template", "w", F.array_distinct("h").alias("set"), "h", windows.alias("bands")).orderBy("template").collect()]
    if short := [r["template"] for r in out if not r["h"]]:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    return out, {x for r in out for x in r["w"]}


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template, containment, first_word: the best window of each document and template.

    Null, empty and short texts match nothing; a null id is one document;
    repeated rows count once; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    known, vocabulary = _templates(spark, TEMPLATES if templates is None else templates)
    low, high = [t for t in known if len(t["h"]) < 2 * WIDE], [t for t in known if len(t["h"]) >= 2 * WIDE]
    longest = max((len(t["h"]) for t in known), default=1)
    # the templates' signatures: of single shingles, and by band of windows
    signed = {(t["template"], -1, x) for t in low for x in t["h"]} | {(t["template"], s, b[s]) for t in high for b in t["bands"] for s in range(BANDS)}
    signature_of = lambda single: sorted({sig for _, band, sig in signed if (band < 0) == single})
    w, at = F.col("w"), F.col("at")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _once(word_hashes(words(F.col(text_col)))).alias("w"))
    # where a shingle of a template may start
    of = lambda i, k: F.get(w, i + k).isin(sorted(vocabulary))
    rows = rows.select("doc_id", "w", (F.size("w") - WIDTH + 1).alias("n"), _once(F.filter(_starts(w), lambda i: of(i, 0) & of(i, 2) & of(i, 4))).alias("at")).where("size(at) > 0")
    entry = lambda band, sig, pos: F.struct(F.lit(band).alias("band"), sig.alias("sig"), pos.alias("pos"))
    single = F.filter(F.transform(at, lambda i: entry(-1, _shingle(w, i), i)), lambda x: x["sig"].isin(signature_of(True)))
    # the windows, every second one, that hold such a place, their shingles, and their bands
    half = WIDE // 2
    last = F.floor((F.col("n") - WIDE) / half) * half
    near = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(half)), lambda k: (F.floor(i / half) * half - k * half).cast("int")))))
    windows = F.transform(F.filter(near, lambda i: (i >= 0) & (i <= last)), lambda i: F.struct(i.alias("i"), F.array(*[_shingle(w, i + k) for k in range(WIDE)]).alias("h")))
    banded = F.filter(F.flatten(F.transform(windows, lambda x: F.array(*[entry(s, _band(x["h"], s), x["i"]) for s in range(BANDS)]))), lambda x: x["sig"].isin(signature_of(False)))
    none = F.array().cast("array<struct<band: int, sig: bigint, pos: int>>")
    rows = rows.select("doc_id", "w", "n", F.explode(F.array_distinct(F.concat(single if low else none, F.when(F.col("n") >= WIDE, banded).otherwise(none) if high else none))).alias("s"))
    start = F.greatest(F.col("s.pos") - longest, F.lit(0))
    rows = rows.select("doc_id", "s.*", "n", start.alias("from"), F.slice("w", start + 1, F.lit(3 * longest + WIDTH - 1)).alias("w"))
    signatures = spark.createDataFrame(sorted(signed), "template string, band int, sig bigint")
    sets = spark.createDataFrame([(t["template"], len(t["h"]), t["set"]) for t in known], "template string, m int, goal array<bigint>")
    found = rows.join(F.broadcast(signatures.join(F.broadcast(sets), "template")), ["band", "sig"]).withColumn("part", _once(F.transform(_starts(w), lambda i: _shingle(w, i))))
    # windows of as many shingles as the template around the place, within the document
    end = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    tried = F.sequence(F.least(F.greatest(F.col("pos") - F.col("m"), F.lit(0)), end), F.least(F.col("pos") + F.col("m"), end))
    share = lambda s: F.size(F.array_intersect(F.slice("part", s - F.col("from") + 1, F.col("m")), "goal")) / F.size("goal")
    best = F.array_max(F.transform(tried, lambda s: F.struct(share(s).alias("containment"), (-s).cast("bigint").alias("back"))))
    floor = math.nextafter(containment, 0)
    return (
        found.groupBy("doc_id", "template").agg(F.max(best).alias("best")).where(F.col("best.containment") >= floor)
        .select("doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))
    )


def oracle_sql(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """The same by brute force over every window, for DuckDB."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(WIDTH))
    words_of = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
        WITH t AS (SELECT template, list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: {run}) AS g FROM (SELECT template, {words_of} AS w FROM (VALUES {values}) v(template, text))),
        d AS (SELECT doc_id, list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: {run}) AS h FROM (SELECT doc_id, {words_of} AS w FROM documents)),
        p AS (SELECT doc_id, template, g, h FROM d JOIN t ON list_has_any(h, g)),
        s AS (SELECT doc_id, template, g, h, unnest(range(0, greatest(len(h) - len(g), 0) + 1)) AS first_word FROM p),
        c AS (SELECT doc_id, template, first_word, len(list_intersect(list_distinct(h[first_word + 1 : first_word + len(g)]), list_distinct(g))) / len(list_distinct(g)) AS containment FROM s)
        SELECT doc_id, template, max(containment) AS containment, CAST(arg_max(first_word, containment * 1e9 - first_word) AS BIGINT) AS first_word
        FROM c GROUP BY doc_id, template HAVING max(containment) >= {containment - 1e-12}"""

"""License scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance.

Units are a text's lines and the sentences in them; each that could reach ``COSINE`` is scored: one is passed over
only if what it shares with any template is bound to give less. (``op2_licenses`` asks for ``marked`` units only, as its SQL
does: those that have two of the templates' terms, one of them not a word of ``COMMON``, which stand in any prose.) A unit's vector has its terms' counts times
their inverse document frequency among the templates (terms that no template has count as the rarest). The best
unit at ``COSINE`` or more gives a file its licence. A file
named LICENSE, LICENCE, COPYING or NOTICE gives it to its directory too; a file without one of its own
takes that of the nearest directory above it which has one. Units are scored once per distinct unit, and
ancestors are looked up once per distinct directory; both are pre-aggregated. All of it is DataFrame
functions, and the templates are a fixed short list.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

COSINE = 0.6
#: Licence names and typical statements of them.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-Clause license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "GNU General Public License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", "GNU Lesser General Public License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain, The Unlicense."),
]


def model(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """Inverse document frequencies, that of unknown terms, and (template, licence, term, unit weight)."""
    counts = [Counter(re.findall(r"[a-z0-9]+", t.lower())) for _, t in templates]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        out += [(k, name, w, n * idf[w] / norm) for w, n in sorted(c.items())]
    return idf, math.log(1 + len(counts)) + 1, out


#: Words and numbers of the templates that say nothing of a licence by themselves.
COMMON = "a and any are as at be by can code except file following for form forms found free in into is it may met mit not of or person program provided purpose source style subject terms that the this to under use v with without work you 0 1 2 3 4"


#: Those of them that are the commonest in prose; ``needed`` takes them last.
PROSE = "a and are as at be by for in is it not of or that the this to with"


def telling(templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    return sorted({term for _, _, term, _ in model(templates)[2]} - {*COMMON.split()})


def needed(templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    """Terms one of which every unit at ``COSINE`` or more has: what each template has besides them is too short a vector."""
    out: set[str] = set()
    _, _, weights = model(templates)
    for k in range(len(templates)):
        rest = {term: x for at, _, term, x in weights if at == k}
        while math.sqrt(sum(x * x for x in rest.values())) >= COSINE - 1e-5:
            first = max(rest, key=lambda t: (t in out, t not in COMMON.split(), t not in PROSE.split(), rest[t], t))
            out.add(first)
            del rest[first]
    return sorted(out)


def line_licenses(lines: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(line, license, cosine) for the distinct values in ``line`` that reach ``COSINE``; ties go to the first name."""
    spark = lines.sparkSession
    idf, rare, weights = model(templates)
    w = spark.createDataFrame([(k, n, t, x, idf[t]) for k, n, t, x in weights], "k int, license string, term string, weight double, idf double")
    known = w.select("term", "idf").distinct()
    terms = lines.select("line").distinct().select("line", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    terms = terms.join(F.broadcast(known), "term", "left").select("line", "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("x"))
    norm = terms.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = terms.join(F.broadcast(w.select("k", "license", "term", "weight")), "term").groupBy("line", "k", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cos = dots.join(norm, "line").select("line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= COSINE)
    best = cos.groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b"))
    return best.select("line", F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine"))


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit("([a-z0-9]+)"), F.lit(1))


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, marked: bool = False) -> DataFrame:
    """One row per row of ``files`` (id, path, text): id, path, license, cosine, found ("header", "directory" or null).

    Null texts and paths count as empty; a file without a directory is in directory "". Files that share
    path and text are judged alike. Of several licence files in a directory the best cosine counts. An
    empty table gives no rows; other columns are ignored. ``marked`` leaves out units that reach the threshold by common
    words or by one term alone.
    """
    idf, _, _ = model(templates)
    text = F.coalesce("text", F.lit(""))
    rows = files.select("id", F.coalesce("path", F.lit("")).alias("path"), F.xxhash64(text).alias("th"), text.alias("text"))
    told, known = (F.array(*[F.lit(t) for t in x]) for x in (telling(templates) if marked else needed(templates), sorted(idf)))
    tells = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), told)
    sentences = F.split(F.regexp_replace("text", "([.!?;]) +", "$1\n"), "\n")
    lines = rows.where(tells("text")).select("path", "th", F.explode(F.array_union(F.split("text", "\n"), sentences)).alias("line"))
    lines, terms = lines.where(tells("line")), _terms(F.col("line"))
    if marked:
        lines = lines.where(F.size(F.array_intersect(terms, known)) >= 2)
    else:
        # m terms of the templates, repeats counted, make a vector of at most m times the rarest term; each other term adds that once at least.
        other = F.size(F.array_except(terms, known))
        m = F.size(F.filter(terms, lambda t: F.array_contains(known, t)))
        lines = lines.where(m * m >= other * (COSINE**2 / (1 - COSINE**2) - 1e-4))
    lines = kept(lines.distinct(), "lines")
    scored = kept(line_licenses(lines, templates), "scored")
    own = lines.join(scored, "line").groupBy("path", "th").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b"))
    own = kept(own.select("path", "th", F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine")), "own")
    dirs = own.where(F.col("path").rlike(r"(^|/)(LICEN[SC]E|COPYING|NOTICE)(\.[^/]*)?$")).select(_dir(F.col("path")).alias("dir"), "license", "cosine")
    dirs = dirs.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine"))
    places = rows.select(_dir(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ups = places.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "above"))
    ups = ups.join(kept(dirs, "dirs"), "above").groupBy("dir").agg(F.max(F.struct("depth", "license", "cosine")).alias("b"))
    inherited = kept(ups.select("dir", F.col("b.license").alias("dir_license"), F.col("b.cosine").alias("dir_cosine")), "inherited")
    out = rows.select("id", "path", "th", _dir(F.col("path")).alias("dir")).join(own, ["path", "th"], "left").join(inherited, "dir", "left")
    found = F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "directory")
    return out.select("id", "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("cosine", "dir_cosine").alias("cosine"), found.alias("found"))


def _dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


#: The documents laid out as files: 16 to a directory, 16 directories to the next, under their source; each directory's first is its licence file.
PATH = """concat(coalesce(source, ''), '/', cast(floor(doc_id / 256) as bigint), '/', cast(floor(doc_id / 16) % 16 as bigint), '/', case when doc_id % 16 = 0 then 'LICENSE' else concat(doc_id, '.txt') end)"""


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("doc_id").alias("id"), F.expr(PATH).alias("path"), "text")
    return license_scan(files, marked=True).withColumnRenamed("id", "doc_id")


def _op2_sql() -> str:
    idf, rare, weights = model()
    w = ", ".join(f"({k}, '{n}', '{t}', {x!r}::double, {idf[t]!r}::double)" for k, n, t, x in weights)
    told = ", ".join(f"'{t}'" for t in telling())
    cut = r"regexp_replace(text, '([.!?;]) +', '\\1' || chr(10), 'g')"
    return f"""
with w(k, license, term, weight, idf) as (values {w}),
f as (select doc_id, {PATH} as path, coalesce(text, '') as text from documents),
d as (select *, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir from f),
l as (select distinct unnest(string_split(text, chr(10)) || string_split({cut}, chr(10))) as line from f),
t as (select line, term, count(*) as tf from (select line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from l) group by all),
cand as (select line from t where term in (select term from w) group by line having count(*) >= 2 and bool_or(term in ({told}))),
x as (select line, t.term, tf * coalesce(i.idf, {rare!r}) as x from t semi join cand using (line) left join (select distinct term, idf from w) i using (term)),
n as (select line, sqrt(sum(x * x)) as norm from x group by line),
c as (select line, license, round(sum(x * weight) / any_value(norm), 6) as cosine from x join w using (term) join n using (line) group by line, k, license),
b as (select line, min((-cosine, license)) as b from c where cosine >= {COSINE} group by line),
own as (select doc_id, path, dir, min(b) as b from (select doc_id, path, dir, unnest(string_split(text, chr(10)) || string_split({cut}, chr(10))) as line from d) join b using (line) group by all),
dirs as (select dir, min(b) as b from own where regexp_matches(path, '(^|/)(LICEN[SC]E|COPYING|NOTICE)(\\.[^/]*)?$') group by dir),
inh as (select d.doc_id, max((length(dirs.dir), dirs.b)) as m from d join dirs on d.dir = dirs.dir or starts_with(d.dir, dirs.dir || '/') or dirs.dir = '' group by d.doc_id)
select d.doc_id, d.path, coalesce(own.b[2], inh.m[2][2]) as license, -coalesce(own.b[1], inh.m[2][1]) as cosine,
  case when own.b is not null then 'header' when inh.m is not null then 'directory' end as found
from d left join own on own.doc_id = d.doc_id left join inh on inh.doc_id = d.doc_id
"""


OP2_SQL = _op2_sql()

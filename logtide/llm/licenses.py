"""Licence scans: TF-IDF cosine of headers and licence files to templates, and inheritance from ancestor directories.

Only DataFrame functions. Licence files are compared as whole texts, all files by windows around header words and by
SPDX identifiers. Vectors stay sparse: a row for each passage and term, so a cosine is a join on the term.
"""

from __future__ import annotations

import pathlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.storage import written

#: Names and texts of the licence statements that are looked for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Further header statements; SPDX identifiers and the texts of ``licence_texts`` are templates too.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Licensed under the MIT License."),
]
_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
_TEXTS = pathlib.Path(__file__).with_name("licence_texts")
#: A term is the middle of a header window if it begins with one of these.
HEADER = r"(?i)licen[cs]e|copyright|spdx"
#: Least cosine of a match, and rows that a directory's row is copied to against hot directories.
LEAST, SALTS = 0.6, 16


def template_rows() -> list[tuple[str, str, str]]:
    """``(license, kind, text)``: ``header`` statements, ``spdx`` identifiers and ``file`` texts of whole licences."""
    full = [(p.stem, "file", p.read_text()) for p in sorted(_TEXTS.glob("*.txt"))]
    headers = [(k, "header", v) for k, v in [*TEMPLATES.items(), *HEADERS]]
    names = sorted({k for k, _, _ in full + headers})
    spdx = [(n, "spdx", n + e) for n in names for e in (("", "-only", "-or-later", "+") if n in _GNU else ("",))]
    return full + headers + spdx


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "license string, kind string, text string")


def _terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def passages(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: Column | None = None) -> DataFrame:
    """``(path, kind, terms)`` to compare, equal ones of a file once.

    ``spdx``: each identifier after an SPDX tag. ``file``: the whole text of a licence file. ``header``: windows around
    each term that begins like ``HEADER``, as long as header templates are, line ends ignored: those that begin with
    the first term of one, and others that overlap by half.
    """
    heads = templates.where("kind = 'header'").select(_terms(F.col("text")).alias("t"))
    shape = heads.agg(F.array_distinct(F.collect_list(F.size("t"))).alias("sizes"), F.array_distinct(F.collect_list(F.col("t")[0])).alias("firsts"))  # one row
    text = F.col(text_col)
    rows = files.select(F.col(path_col).alias("path"), text.alias("text"), F.coalesce(licence_file, F.lit(False)).alias("_is")).where(F.col("_is") | text.rlike(HEADER))
    tags = F.regexp_extract_all("text", F.lit(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)"), F.lit(1))
    names = F.regexp_extract_all(F.lower(F.col("tag")), F.lit("[a-z0-9.+-]+"), F.lit(0))
    spdx = rows.select("path", F.explode(tags).alias("tag")).select("path", F.lit("spdx").alias("kind"), F.explode(names).alias("id")).select("path", "kind", F.array("id").alias("terms"))
    whole = rows.where("_is").select("path", F.lit("file").alias("kind"), _terms(F.col("text")).alias("terms"))
    cut = rows.where(text.rlike(HEADER)).select("path", _terms(F.col("text")).alias("t")).join(F.broadcast(shape))
    middle = F.expr("filter(sequence(0, size(t) - 1), p -> t[p] rlike '^(licen[cs]e|copyright)')")
    cut = cut.where("size(t) > 0").select("path", "t", "sizes", "firsts", F.explode(middle).alias("p")).select("path", "t", "firsts", "p", F.explode("sizes").alias("n"))
    begin = "filter(sequence(greatest(0, p - n + 1), p), s -> (p - s) % greatest(1, int(n / 2)) = 0 OR array_contains(firsts, t[s]))"
    windows = cut.select("path", F.lit("header").alias("kind"), "t", "n", F.explode(F.expr(begin)).alias("s")).select("path", "kind", F.slice("t", F.col("s") + 1, F.col("n")).alias("terms"))
    return spdx.unionByName(whole).unionByName(windows).where("size(terms) > 0").distinct()


def matches(found: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """``(kind, terms, license, cosine)``: the best template of each different passage; ties go to the first name.

    A term's weight is its count times ``1 + ln((1 + n) / (1 + df))`` over the ``n`` templates of the passage's kind;
    equal passages are one, so one that a third of all files hold is compared once.
    """
    lines = written(found.select("kind", "terms").distinct().withColumn("pid", F.expr("uuid()")), "license-passages")
    counted = lines.select("kind", "pid", F.explode("terms").alias("term")).groupBy("kind", "pid", "term").agg(F.count("*").alias("tf"))
    texts = templates.withColumn("terms", F.when(F.col("kind") == "spdx", F.array(F.lower("text"))).otherwise(_terms(F.col("text")))).withColumn("tid", F.xxhash64("license", "kind", "text"))
    wanted = texts.select("kind", "license", "tid", F.explode("terms").alias("term")).groupBy("kind", "license", "tid", "term").agg(F.count("*").alias("tf"))
    df = wanted.groupBy("kind", "term").agg(F.count("*").alias("df"))
    n = texts.groupBy("kind").agg(F.count("*").alias("n"))  # a row for each kind
    weight = F.col("tf") * (1 + F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))))
    weighed = counted.join(F.broadcast(df), ["kind", "term"], "left").join(F.broadcast(n), "kind").select("kind", "pid", "term", weight.alias("w"))
    wanted = wanted.join(df, ["kind", "term"]).join(n, "kind").select("kind", "license", "tid", "term", weight.alias("v"))
    sizes = wanted.groupBy("tid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v_size"))
    wanted = wanted.join(sizes, "tid")
    weighed = written(weighed, "license-weights")
    size = weighed.groupBy("pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_size"))
    dots = weighed.join(F.broadcast(wanted), ["kind", "term"]).groupBy("pid", "tid", "license", "v_size").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(size, "pid").select("pid", "license", F.round(F.col("dot") / (F.col("w_size") * F.col("v_size")), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")
    named = scored.groupBy("pid").agg(best).select("pid", "b.license", (-F.col("b.c")).alias("cosine"))
    return lines.join(named, "pid").select("kind", "terms", "license", "cosine")


def scan(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: Column | None = None, least: float = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(*carry, path, license, cosine, origin)`` for each row of ``files``; ``carry`` names columns to hand on.

    ``origin`` is ``declared`` for a file with a matching passage of its own (a licence file's whole text counts before
    its headers), else ``inherited`` if an ancestor
    directory has a licence file (``licence_file`` says which rows are; by default names like LICENSE or COPYING),
    the nearest one's, else ``none``. Several matching headers, or licence files of one directory: the highest cosine,
    then the first name. Null and empty texts declare nothing; null paths inherit nothing, but declare; rows of one path
    declare by their own texts; repeated rows stay repeated.
    """
    if licence_file is None:
        licence_file = F.element_at(F.split(F.col(path_col), "/"), -1).rlike(r"(?i)^(licen[cs]e|copying|notice)(\..*)?$")
    own_key = F.struct(F.coalesce(path_col, F.lit("")).alias("path"), F.col(path_col).isNull().alias("none"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"))
    found = written(passages(files.withColumn("_key", own_key), templates, "_key", text_col, licence_file), "license-found")
    hits = found.join(matches(found, templates, least), ["kind", "terms"])
    best = F.min(F.struct((F.col("kind") != "file").alias("part"), (-F.col("cosine")).alias("c"), "license")).alias("own")
    own = written(hits.groupBy(F.col("path").alias("_key")).agg(best), "license-own")
    rows = files.select(*carry, F.col(path_col).alias("path"), own_key.alias("_key"), F.coalesce(licence_file, F.lit(False)).alias("_is"))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    of_dir = rows.where("_is").select("path", "_key").distinct().join(own, "_key").groupBy(parent.alias("dir")).agg(F.min("own").alias("up"))
    parts = F.split(F.col("dir"), "/")
    dirs = rows.select(parent.alias("dir")).distinct().where("dir IS NOT NULL")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up_dir"))
    above = above.select("dir", "up_dir", F.length("up_dir").alias("deep")).distinct()
    near = above.join(of_dir.withColumnRenamed("dir", "up_dir"), "up_dir").groupBy("dir").agg(F.max_by("up", "deep").alias("up"))
    near = near.select("dir", "up", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = rows.select(*carry, "path", "_key", parent.alias("dir"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    out = keyed.join(own, "_key", "left").join(near, ["dir", "salt"], "left")
    origin = F.when(F.col("own").isNotNull(), "declared").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    chosen = F.coalesce("own", "up")
    return out.select(*carry, "path", chosen["license"].alias("license"), (-chosen["c"]).alias("cosine"), origin.alias("origin"))

"""License notices in texts, in DataFrame functions only.

Texts and templates are words of lower-case letters and digits; both are sets of WIDTH-word shingles. A text is looked at
in overlapping windows: for templates of L words, L + STRIDE - 1 words every STRIDE words, so that one window always holds
a notice whole. Each window has BANDS MinHash values of one row each, and retrieves the templates that have the same value
in any band; then exact containment (the share of the template's shingles in the window) decides.

A window that holds a notice at containment 0.8 or more has a Jaccard similarity of 0.5 or more to it, and so misses all
BANDS bands with a probability under 0.5**16. Bands are looked up from the template's side first: a window can only share
a band value if it holds the shingle that has the template's minimum there, so signatures are made for windows around such
shingles only. Nothing but those windows leaves the scan.

Defined results: one row for each document and template found in it; null, empty and short texts have none; repeated rows
are counted together; an empty table or no templates give no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 5
BANDS = 16
CONTAINMENT = 0.8
#: Tables made from the templates are broadcast up to so many templates, and joined by shuffle beyond.
MAX_BROADCAST = 2_000

#: Fixed notices that are looked for: (license, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def stride(length: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(length / 4).cast("int"))


def words_of(text: str) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _shingle(i: str) -> str:
    return "xxhash64(" + ", ".join(f"words[{i} + {k}]" for k in range(WIDTH)) + ")"


def _hashes() -> Column:
    return F.expr(f"CASE WHEN size(words) >= {WIDTH} THEN transform(sequence(0, size(words) - {WIDTH}), i -> {_shingle('i')}) ELSE CAST(array() AS ARRAY<BIGINT>) END")


def templates(spark: SparkSession, given: list[tuple[str, str]]) -> DataFrame:
    """(template, license, length, hs) of templates of WIDTH words or more."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(given)], "template int, license string, text string")
    rows = rows.withColumn("words", words_of("text")).withColumn("hs", F.array_distinct(_hashes()))
    return rows.where(F.size("hs") > 0).select("template", "license", F.size("words").alias("length"), "hs")


def scan(docs: DataFrame, notices: DataFrame, n_notices: int) -> DataFrame:
    """(doc_id, license, template, n_windows, containment, first_word) of the notices found."""
    small = F.broadcast if n_notices <= MAX_BROADCAST else lambda df: df
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    values = notices.select("template", "length", "hs", band.alias("band")).select("template", "length", "band", F.expr("array_min(transform(hs, x -> xxhash64(x, band)))").alias("value"), F.expr("array_min(transform(hs, x -> struct(xxhash64(x, band) AS v, x AS x))).x").alias("h"))

    words = docs.select("doc_id", words_of("text").alias("words")).where(F.size("words") >= WIDTH)
    places = words.select("doc_id", "words", F.explode(F.expr(f"sequence(0, size(words) - {WIDTH})")).alias("i"))
    near = places.withColumn("h", F.expr(_shingle("i"))).join(small(values.select("h", "length").distinct()), "h")
    width, step = F.col("length") + stride(F.col("length")) - 1, stride(F.col("length"))
    first = (F.ceil(F.greatest(F.lit(0), F.col("i") + WIDTH - width) / step) * step).cast("int")
    last = (F.floor(F.col("i") / step) * step).cast("int")
    windows = near.withColumn("first", first).withColumn("last", last).where("first <= last")
    windows = windows.select("doc_id", "length", F.col("words").alias("all"), F.explode(F.sequence("first", "last", step)).alias("start"))
    windows = windows.select("doc_id", "length", "start", F.slice("all", F.col("start") + 1, width).alias("words")).distinct()
    signed = windows.withColumn("own", F.array_distinct(_hashes())).drop("words").where(F.size("own") > 0)
    banded = signed.select("*", band.alias("band")).withColumn("value", F.expr("array_min(transform(own, x -> xxhash64(x, band)))"))
    found = banded.join(small(values.select("template", "length", "band", "value")), ["length", "band", "value"]).select("doc_id", "start", "own", "template").distinct()
    exact = found.join(small(notices.select("template", "license", "hs")), "template").withColumn("containment", F.size(F.array_intersect("own", "hs")) / F.size("hs"))
    return exact.where(F.col("containment") >= CONTAINMENT).groupBy("doc_id", "license", "template").agg(F.count("*").alias("n_windows"), F.round(F.max("containment"), 6).alias("containment"), F.min("start").cast("long").alias("first_word"))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_PLAIN = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH t AS (SELECT *, len(words) AS length, greatest(2, CAST(floor(len(words) / 4) AS INTEGER)) AS step FROM (SELECT template, license, {_PLAIN} AS words FROM (VALUES {_VALUES}) AS v(template, license, text))),
ts AS (SELECT DISTINCT template, license, length, step, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, length - 3)) AS i FROM t)),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
d AS (SELECT doc_id, {_PLAIN} AS words FROM documents),
p AS (SELECT doc_id, i - 1 AS i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) > 4)),
hit AS (SELECT doc_id, i, template, license, length, step, p.k FROM p JOIN ts ON p.k = ts.k),
w AS (SELECT *, unnest(range(CAST(ceil(greatest(0, i + 5 - (length + step - 1)) / step) AS BIGINT) * step, CAST(floor(i / step) AS BIGINT) * step + 1, step)) AS start FROM hit),
c AS (SELECT doc_id, license, template, start, count(DISTINCT k) AS got FROM w GROUP BY ALL)
SELECT doc_id, license, template, count(*) AS n_windows, round(max(got / n), 6) AS containment, min(start) AS first_word
FROM c JOIN tn USING (template) WHERE got >= 0.8 * n GROUP BY doc_id, license, template
"""

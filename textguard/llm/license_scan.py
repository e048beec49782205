"""License texts in documents by MinHash bands over overlapping windows.

Method: a template is the set of its five-word shingles. A document is read
through overlapping windows twice as long as the template (in shingles), one
template length apart, so every occurrence lies whole in some window. Each
window has ``BANDS`` MinHash bands of one row; a window that shares a band
with a template retrieves it, and the exact share of the template's shingles
that stand in the window (containment) decides: ``CONTAINMENT`` or more is a
match.

Band settings: a window that holds a whole template has Jaccard similarity of
at least 1/2 with it and misses all 24 bands with probability 2**-24; at
containment 0.8 it is at least 0.8 / 2.2 and the miss is below 2e-5.

A band of a window can equal a template's only if the window holds the
template's minimum shingle of that band. So bands are computed only for windows
around such shingles: the intersection of a document's shingles with the
templates' minimum shingles (a short literal set) picks the rows and the
places. All of it is expressions over one row; only matches are shuffled.

Words are runs of letters and digits, lower case.

Edge cases: null, empty and short texts (below five words) match nothing;
templates need five words; a null doc_id is a group of its own and rows that
share a doc_id are reported together; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 24
CONTAINMENT = 0.8

#: Opening words or notices of widely used public licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                 "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                          "following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once: a filter that the optimizer
    moves below a projection would else put the value into every lambda."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def shingles(word_list: Column) -> Column:
    """Hashes of the five-word shingles in order (empty below five words)."""
    return _let(F.transform(word_list, lambda x: F.xxhash64(x)), _runs)


def _runs(w: Column) -> Column:
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))) \
        .otherwise(F.array().cast("array<bigint>"))


def _band(shingle: Column, band) -> Column:
    """The shingle's place in the permutation of a band."""
    return F.xxhash64(shingle, band)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """One row per template and band: template, scale (shingle places), all
    distinct shingles, band, minimum place and the shingle that has it."""
    short = [t for t, text in templates.items() if len(template_words(text)) < SHINGLE]
    if short:
        raise ValueError(f"templates below {SHINGLE} words: {short}")
    rows = spark.createDataFrame([(t, template_words(text)) for t, text in sorted(templates.items())], "template string, words array<string>")
    t = rows.select("template", shingles(F.col("words")).alias("h")).select("template", F.size("h").alias("scale"), F.array_distinct("h").alias("t_set"))
    t = t.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    least = F.array_min(F.transform("t_set", lambda x: F.struct(_band(x, F.col("band")).alias("key"), x.alias("shingle"))))
    return t.withColumn("m", least).select("template", "scale", "t_set", "band", F.col("m.key").alias("key"), F.col("m.shingle").alias("shingle"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and template found in it: doc_id, template,
    n_windows that match, containment (the best window's) and first_word, the
    word at which the first matching window begins (from 0)."""
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    # bands x templates rows at most: the templates are a parameter, not data
    anchors = F.array(*[F.lit(r.shingle) for r in table.select("shingle").distinct().orderBy("shingle").collect()]).cast("array<bigint>")
    d = docs.select(F.col(key).alias("doc_id"), shingles(words(F.col(text))).alias("h")).where(F.size(F.array_intersect("h", anchors)) > 0)
    places = _let(F.array_intersect("h", anchors), lambda near: F.filter(F.transform("h", lambda x, i: F.struct(i.alias("pos"), x.alias("shingle"))),
                                                                         lambda e: F.array_contains(near, e["shingle"])))
    # a place takes along what its windows can hold, not the whole text
    reach = 2 * max((r.scale for r in table.select("scale").distinct().collect()), default=0)
    hits = d.select("doc_id", "h", F.explode(places).alias("e")).select("doc_id", "e.pos", "e.shingle", F.greatest(F.col("e.pos") - reach, F.lit(0)).alias("from"),
                                                                        F.slice("h", F.greatest(F.col("e.pos") - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near"))
    hits = hits.join(F.broadcast(table), "shingle")
    # the two windows that hold the place
    hits = hits.withColumn("k", F.explode(F.array(F.floor(F.col("pos") / F.col("scale")), F.floor(F.col("pos") / F.col("scale")) - 1))).where("k >= 0")
    hits = hits.withColumn("window", F.slice("near", (F.col("k") * F.col("scale") - F.col("from") + 1).cast("int"), (2 * F.col("scale")).cast("int")))
    shared = hits.where(F.array_min(F.transform("window", lambda x: _band(x, F.col("band")))) == F.col("key"))
    found = shared.withColumn("containment", F.size(F.array_intersect("window", "t_set")) / F.size("t_set")).where(F.col("containment") >= containment)
    per_window = found.groupBy("doc_id", "template", "k").agg(F.max("containment").alias("containment"), F.min(F.col("k") * F.col("scale")).alias("first"))
    return per_window.groupBy("doc_id", "template").agg(F.count("*").alias("n_windows"), F.max("containment").alias("containment"), F.min("first").cast("long").alias("first_word"))


def _sql() -> str:
    quoted = ", ".join(f"('{t}', ['" + "', '".join(template_words(x)) + "'])" for t, x in sorted(TEMPLATES.items()))
    return f"""
WITH t AS (SELECT template, list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS s FROM (VALUES {quoted}) v(template, w)),
ts AS (SELECT template, len(s) AS scale, list_distinct(s) AS t_set FROM t),
tx AS (SELECT template, scale, len(t_set) AS n, unnest(t_set) AS shingle FROM ts),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
hit AS (SELECT doc_id, template, scale, n, ds.shingle, unnest([pos // scale, pos // scale - 1]) AS k FROM ds JOIN tx ON ds.shingle = tx.shingle),
win AS (SELECT doc_id, template, k, k * scale AS first, count(DISTINCT shingle) / n AS containment FROM hit WHERE k >= 0 GROUP BY doc_id, template, k, scale, n)
SELECT doc_id, template, count(*) AS n_windows, max(containment) AS containment, CAST(min(first) AS BIGINT) AS first_word
FROM win WHERE containment >= {CONTAINMENT} GROUP BY doc_id, template"""


SQL = _sql()

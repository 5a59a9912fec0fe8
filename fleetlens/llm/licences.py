"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored, text_of

THRESHOLD = 0.7
#: Base names of licence files, lower case.
LICENCE_FILES = ("license", "license.txt", "license.md", "licence", "licence.txt", "licence.md", "copying", "copying.txt", "unlicense")

# Wording of public licence notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Every template holds one of these terms. Nothing selects by them: the scan takes every unit that can reach the threshold, the SQL every unit.
CUES = (
    "licensed", "license", "licenced", "licence", "released", "spdx-license-identifier", "permission", "redistribution",
    "redistribute", "cc0", "domain",
)
_TERM = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"


def terms(text: Column) -> Column:
    """Terms of a text: ASCII letters and digits of the lower-case text, with inner dots, pluses and hyphens."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({_TERM})"), F.lit(1))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """Terms of the templates with their counts: ``template``, ``licence``, ``term``, ``tf``."""
    rows = [(f"{name}/{i}", name, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "template string, licence string, text string")
    frame = frame.select("template", "licence", F.explode(terms(F.col("text"))).alias("term"))
    return stored(frame.groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf")))


def needed_terms(weights: dict[str, dict[str, float]], least: float) -> set[str]:
    """Terms of which a unit holds one if its cosine to any template is ``least`` or more.

    The cosine is at most the length of the template's part on shared terms over its whole length. So the lightest terms of
    each template are left out as long as they alone stay below ``least``.
    """
    needed: set[str] = set()
    for own in weights.values():
        room = least * least * (1 - 1e-9) * sum(w * w for w in own.values())
        light = 0.0
        for term, w in sorted(own.items(), key=lambda x: (x[1], x[0])):
            light += w * w
            if light >= room:
                needed.add(term)
    return needed


def may_reach(units_terms: Column, needed: set[str], idf: dict[str, float], unseen: float, least: float) -> Column:
    """False only for units (their terms, with repeats) whose cosine to every template is below ``least``.

    Beside a needed term, enough of the unit's own length has to lie on terms of templates.
    """
    weights = F.map_from_arrays(F.lit(list(idf)), F.lit(list(idf.values())))
    room = least * least * (1 - 1e-9)

    def enough(found: Column) -> Column:
        def square(term: Column) -> Column:
            return F.pow(F.size(F.filter(found, lambda x: x == term)) * F.element_at(weights, term), F.lit(2.0))

        shared = F.array_intersect(found, F.lit(list(idf)))
        on = F.aggregate(F.transform(shared, square), F.lit(0.0), lambda total, x: total + x)
        off = F.size(F.array_except(found, F.lit(list(idf)))) * F.lit(unseen * unseen)
        return on >= F.lit(room) * (on + off)

    once = F.element_at(F.transform(F.array(units_terms), enough), 1)
    return F.arrays_overlap(units_terms, F.lit(sorted(needed))) & once


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The licence each file states itself, and the one it inherits.

    ``files`` has ``doc_id``, ``path`` and ``text``. Every line of a text is a
    unit to compare, and the whole text of a licence file (by its base name) is
    one more. A unit's weights are term count times ln((1 + N) / (1 + lines with
    the term)) + 1 over the N lines of all files; terms that no template has
    count as never seen. The template of greatest cosine wins (ties: by name), if
    it reaches ``threshold``; the best unit gives ``own_licence`` and ``score``
    (rounded to 4 places). Units that cannot reach it are told by exact bounds and not joined. Lines are scored once however often they occur.

    A file without a licence of its own takes that of the nearest directory
    above (its own first) with a licence file that states one; of several, the
    best score, then name. ``licence`` is the result, ``licence_dir`` the directory
    inherited from (null if stated in the file or unknown).

    Null or empty text states nothing and may inherit; a file with a null path
    lies in no directory and inherits nothing. Repeated rows are repeated. Columns
    besides the three are dropped. An empty table gives none.
    """
    spark = files.sparkSession
    known = template_table(spark, templates or TEMPLATES)
    of_templates = known.collect()  # of the templates alone
    vocabulary = sorted({r.term for r in of_templates})
    files = files.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))

    lines = files.select(F.explode(F.split(text_of("text"), "\n")).alias("line"))
    held = F.array_intersect(terms(F.col("line")), F.lit(vocabulary))
    counted = lines.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("term"))  # "" counts the lines themselves
    seen = stored(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    counts = {r.term: r.df for r in seen.collect()}  # one row per term of the templates
    n = float(counts.get("", 0))

    def idf(df: Column) -> Column:
        return F.log(F.lit(1.0 + n) / (1.0 + df)) + 1.0

    base = F.lower(F.element_at(F.split("path", "/"), -1))
    is_file = F.coalesce(base.isin(*LICENCE_FILES), F.lit(False))
    units = F.split(text_of("text"), "\n")
    idfs = {term: math.log((1.0 + n) / (1.0 + counts.get(term, 0))) + 1.0 for term in vocabulary}
    by_template: dict[str, dict[str, float]] = {}
    for r in of_templates:
        by_template.setdefault(r.template, {})[r.term] = r.tf * idfs[r.term]
    least = max(0.0, threshold - 1e-4)  # scores are rounded to 4 places
    near = may_reach(terms(F.col("unit")), needed_terms(by_template, least), idfs, math.log(1.0 + n) + 1.0, least)
    named = files.withColumn("_file", is_file)
    named = named.withColumn("unit", F.explode(F.when(F.col("_file"), F.concat(units, F.array(text_of("text")))).otherwise(units)))
    found = stored(named.where(near).select("doc_id", "path", "_file", F.md5("unit").alias("unit"), F.col("unit").alias("words")))

    # from here on a unit is its hash: its words travel once, to the task that counts its terms
    distinct = found.groupBy("unit").agg(F.first("words").alias("words"))
    tf = distinct.select("unit", F.explode(terms(F.col("words"))).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = found.drop("words")
    tf = tf.join(seen, "term", "left").withColumn("w", F.col("tf") * idf(F.coalesce("df", F.lit(0))))
    lengths = tf.groupBy("unit").agg(F.sum(F.col("w") * F.col("w")).alias("uu"))
    weights = known.join(seen, "term", "left").withColumn("t", F.col("tf") * idf(F.coalesce("df", F.lit(0))))
    sizes = weights.groupBy("template", "licence").agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    dots = tf.select("unit", "term", "w").join(weights.select("template", "term", "t"), "term")
    dots = dots.groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosines = dots.join(lengths, "unit").join(sizes, "template")
    cosines = cosines.withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("uu") * F.col("tt")), 4))
    best = cosines.where(F.col("score") >= threshold).groupBy("unit").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best")
    )
    stated = found.join(best, "unit").groupBy("doc_id", "path", "_file").agg(F.min("best").alias("best"))
    stated = stored(stated.select("doc_id", "path", "_file", F.col("best.licence").alias("own_licence"), (-F.col("best.s")).alias("score")))

    def directory(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")

    files = files.select("doc_id", "path").withColumn("_dir", directory(F.col("path")))
    rule = stated.where("_file AND path IS NOT NULL").withColumn("licence_dir", directory(F.col("path")))
    rule = rule.groupBy("licence_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "own_licence")).alias("_rule"))
    dirs = files.select("_dir").where("_dir IS NOT NULL").distinct()
    above = F.split("_dir", "/")
    climbed = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(above))))
    climbed = climbed.withColumn("licence_dir", F.array_join(F.slice(above, F.lit(1), F.col("depth")), "/"))
    climbed = climbed.join(rule, "licence_dir")
    inherited = climbed.groupBy("_dir").agg(F.max(F.struct("depth", "licence_dir", F.col("_rule.own_licence").alias("licence"))).alias("_up"))
    inherited = stored(inherited)

    out = files.withColumnRenamed("doc_id", "_id").withColumnRenamed("path", "_path")
    own = stated.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "own_licence")).alias("_own"))
    out = out.join(own, F.col("_id").eqNullSafe(own["doc_id"]) & F.col("_path").eqNullSafe(own["path"]), "left").drop("doc_id", "path")
    out = out.join(inherited, "_dir", "left")
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_path").alias("path"), F.col("_own.own_licence").alias("own_licence"),
        (-F.col("_own.s")).alias("score"),
        F.coalesce("_own.own_licence", "_up.licence").alias("licence"),
        F.when(F.col("_own").isNull(), F.col("_up.licence_dir")).alias("licence_dir"),
    )


#: Depth 1 to 3 below the source; texts of under 600 characters play the licence files, at the depth their number gives.
PATH_SQL = (
    "concat_ws('/', coalesce(source, ''), CASE WHEN n > 0 THEN concat('p', CAST(doc_id % 7 AS STRING)) END, "
    "CASE WHEN n > 1 THEN concat('q', CAST(doc_id % 5 AS STRING)) END, "
    "CASE WHEN short THEN 'LICENSE' ELSE concat('doc_', CAST(doc_id AS STRING), '.txt') END)"
)


def op3_query(docs: DataFrame) -> DataFrame:
    """Paths are derived, as ``documents`` has none: directories from source and doc_id, short texts as licence files."""
    short = F.coalesce(F.length("text") < 600, F.lit(True))
    files = docs.withColumn("short", short).withColumn("n", F.when(F.col("short"), F.col("doc_id") % 3).otherwise(2))
    return scan(files.withColumn("path", F.expr(PATH_SQL)).select("doc_id", "path", "text"))


def _oracle() -> str:
    rows = [(f"{name}/{i}", name, text.replace("'", "''")) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    values = ", ".join(f"('{t}', '{n}', '{x}')" for t, n, x in rows)
    return rf"""
WITH templates(template, licence, text) AS (VALUES {values}
), known AS (
  SELECT template, licence, term, count(*) AS tf FROM (
    SELECT template, licence, unnest(regexp_extract_all(lower(text), '({_TERM})')) AS term FROM templates) GROUP BY ALL
), files AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(length(text) < 600, true) AS short,
    CASE WHEN coalesce(length(text) < 600, true) THEN doc_id % 3 ELSE 2 END AS n, source FROM documents
), paths AS (
  SELECT *, {PATH_SQL.replace("AS STRING", "AS VARCHAR")} AS path FROM files
), units AS (
  SELECT doc_id, path, short, unnest(string_split(text, chr(10))) AS unit, false AS whole FROM paths
  UNION ALL SELECT doc_id, path, short, text, true FROM paths WHERE short
), split AS (
  SELECT *, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '({_TERM})') AS terms FROM units
), seen AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM split WHERE NOT whole) GROUP BY term
), total AS (
  SELECT count(*)::DOUBLE AS n FROM split WHERE NOT whole
), idf AS (
  SELECT DISTINCT k.term, ln((1 + n) / (1 + coalesce(s.df, 0))) + 1 AS idf FROM known k LEFT JOIN seen s USING (term), total
), candidates AS (
  SELECT DISTINCT unit, terms FROM split
), tf AS (
  SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(terms) AS term FROM candidates) GROUP BY unit, term
), weighed AS (
  SELECT unit, term, tf * coalesce(idf, (SELECT ln(1 + n) + 1 FROM total)) AS w FROM tf LEFT JOIN idf USING (term)
), lengths AS (
  SELECT unit, sum(w * w) AS uu FROM weighed GROUP BY unit
), tw AS (
  SELECT template, licence, term, tf * idf AS t FROM known JOIN idf USING (term)
), cosines AS (
  SELECT unit, licence, round(sum(w * t) / sqrt(max(uu) * max(tt)), 4) AS score FROM weighed JOIN tw USING (term)
    JOIN lengths USING (unit) JOIN (SELECT template, sum(t * t) AS tt FROM tw GROUP BY template) USING (template)
  GROUP BY unit, template, licence
), best AS (
  SELECT unit, arg_min(licence, (-score, licence)) AS licence, max(score) AS score FROM cosines WHERE score >= {THRESHOLD} GROUP BY unit
), stated AS (
  SELECT doc_id, path, short, arg_min(licence, (-score, licence)) AS own_licence, max(score) AS score
  FROM split JOIN best USING (unit) GROUP BY doc_id, path, short
), rules AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS licence_dir, arg_min(own_licence, (-score, own_licence)) AS licence
  FROM stated WHERE short GROUP BY 1
), up AS (
  SELECT p.doc_id, p.path, arg_max(r.licence_dir, length(r.licence_dir)) AS licence_dir, arg_max(r.licence, length(r.licence_dir)) AS licence
  FROM paths p JOIN rules r ON starts_with(p.path, r.licence_dir || '/') GROUP BY p.doc_id, p.path
)
SELECT p.doc_id, p.path, s.own_licence, s.score, coalesce(s.own_licence, u.licence) AS licence,
  CASE WHEN s.own_licence IS NULL THEN u.licence_dir END AS licence_dir
FROM paths p LEFT JOIN stated s ON p.doc_id = s.doc_id AND p.path = s.path LEFT JOIN up u ON p.doc_id = u.doc_id AND p.path = u.path
"""


ORACLE = _oracle()

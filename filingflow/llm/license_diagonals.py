"""License scans by diagonal voting, in DataFrame functions throughout.

1. Every run of ``K`` words of every text is hashed and joined to the places of
   the same run in the license templates; the words themselves confirm a hit.
2. A hit at word p of the text and word t of the template votes for the
   diagonal p - t.  Votes are grouped by text, template and diagonal.
3. Inserted or dropped words move the rest of a passage to a neighbouring
   diagonal.  Each diagonal joins the one with the most votes within ``NEAR``
   (templates of ``LONG`` words or more: ``FAR``) diagonals, ties to the least.
4. A merged span is verified: the words of template and text that its hits
   cover, the lesser of both, over the longer of template and span, must reach
   ``percent``.  That share is its score.
5. Where verified spans of several templates overlap, each word goes to the
   best (score, then words, then the first template); a span that gets fewer
   than half of its words gives way (a license of another version, say).

Short fixed phrases are looked up in the word arrays, with all their places.

The words of a text are never gathered into pairs: the work is the number of
words plus hits, and a window covers one text and one template.  The templates
are broadcast up to ``MAX_BROADCAST_WORDS`` words, joined by shuffle beyond.

Defined results: null, empty and wordless texts have no words, no places and no
labels, score 0; rows equal in id and text, null ids among them, each get the
same result; templates of fewer than ``K`` words are never found by votes;
other columns are dropped.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, NEAR, LONG, FAR = 3, 4, 16, 12
MAX_BROADCAST_WORDS = 200_000

# Words, the phrases with their labels, and notices of public licenses with theirs.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-3.0", "under the GNU Affero General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def license_templates(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, label, words) of a list of labelled notices."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), words(F.lit(text)).alias("words")) for i, (label, text) in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _grams(df: DataFrame, keep: list[str], position: str, gram: str) -> DataFrame:
    """One row per run of K words of ``words``, with its first word's number."""
    runs = F.arrays_zip(*(F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))) for k in range(K)))
    rows = df.select(*keep, F.posexplode(runs).alias(position, "run"))
    parts = [F.col("run").getField(f) for f in rows.schema["run"].dataType.names]
    return rows.where(parts[-1].isNotNull()).select(*keep, position, F.xxhash64(*parts).alias(f"{gram}_hash"), F.concat_ws(" ", *parts).alias(gram))


def _distinct_words(starts: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (K - 1))))))


def license_spans(df: DataFrame, id_col: str, text_col: str, templates: DataFrame, percent: int = 75) -> DataFrame:
    """(id, text_hash, template, label, first_word, after, score) of every verified span, words from 0."""
    key = ["id", "text_hash"]
    total = templates.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    of_templates = _grams(templates.withColumn("length", F.size("words")), ["template", "label", "length"], "t", "of_template")
    if total <= MAX_BROADCAST_WORDS:
        of_templates = F.broadcast(of_templates)
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    hits = _grams(texts, key, "p", "gram").join(of_templates, F.col("gram_hash") == F.col("of_template_hash")).where(F.col("gram").between(F.col("of_template"), F.col("of_template")))
    what = [*key, "template", "label", "length"]
    votes = hits.groupBy(*what, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    # the diagonal of most votes nearby, ties to the least
    own = F.struct(F.size("ts").alias("votes"), (-F.col("diagonal")).alias("negative"))
    along = Window.partitionBy(*what).orderBy("diagonal")
    peak = F.when(F.col("length") >= LONG, F.max(own).over(along.rangeBetween(-FAR, FAR))).otherwise(F.max(own).over(along.rangeBetween(-NEAR, NEAR)))
    merged = votes.withColumn("peak", -peak["negative"]).withColumn("ps", F.transform("ts", lambda t: t + F.col("diagonal"))).groupBy(*what, "peak").agg(
        F.flatten(F.collect_list("ts")).alias("ts"), F.flatten(F.collect_list("ps")).alias("ps"))
    spans = merged.select(*what, F.least(_distinct_words(F.col("ts")), _distinct_words(F.col("ps"))).alias("covered"), F.array_min("ps").alias("first_word"), (F.array_max("ps") + K).alias("after"))
    longer = F.greatest("length", F.col("after") - F.col("first_word"))
    verified = spans.where(100 * F.col("covered") >= percent * longer).withColumn("score", F.col("covered") / longer)
    # every word to the best span over it
    rank = F.struct("score", "length", -F.col("template"))
    claims = verified.withColumn("word", F.explode(F.sequence("first_word", F.col("after") - 1))).withColumn("won", (rank == F.max(rank).over(Window.partitionBy(*key, "word"))).cast("int"))
    kept = claims.groupBy(*key, "template", "label", "first_word", "after", "score").agg(F.sum("won").alias("won"))
    return kept.where(2 * F.col("won") >= F.col("after") - F.col("first_word")).drop("won")


def _places(phrase: str) -> Column:
    """Starts of the phrase in ``words``."""
    parts = phrase.split()
    stands = lambda i: reduce(and_, (F.get("words", i + k) == p for k, p in enumerate(parts)))
    present = reduce(and_, (F.array_contains("words", p) for p in parts))
    return F.when(present, F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.coalesce(stands(i), F.lit(False)))).otherwise(F.array().cast("array<int>"))


def license_scan(df: DataFrame, id_col: str, text_col: str, templates: DataFrame, phrases: list[tuple[str, str]] = PHRASES, percent: int = 75) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    spans = license_spans(df, id_col, text_col, templates, percent)
    found = spans.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_set("label").alias("own"), F.max("score").alias("best"))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    rows = rows.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), *(_places(p).alias(f"places{k}") for k, (p, _) in enumerate(phrases)))
    names = [f"places{k}" for k in range(len(phrases))]
    labels = [F.when(F.size(n) > 0, F.lit(label)) for n, (_, label) in zip(names, phrases)]
    rows = rows.select("id", "text_hash", "n_words", F.concat(*names).alias("places"), F.array_compact(F.array(*labels)).alias("base"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return both.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"))


def op11_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs, "doc_id", "text", license_templates(spark))


def _sql() -> str:
    word = f"regexp_extract_all(translate(coalesce(%s, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    template = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    place = " || ".join("[i - 1 FOR i IN range(1, len(w) + 1) IF " + " AND ".join(f"coalesce(w[i + {k}] = '{p}', false)" for k, p in enumerate(phrase.split())) + "]" for phrase, _ in PHRASES)
    base = ", ".join(f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {phrase} ') THEN '{label}' END" for phrase, label in PHRASES)
    run = " AND ".join(f"d.w[d.i + {k}] = m.w[m.i + {k}]" for k in range(K))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {word % 'text'} AS w FROM documents),
m AS (SELECT template, label, {word % 'notice'} AS w FROM (VALUES {template}) AS v(template, label, notice)),
hits AS (SELECT DISTINCT d.r, m.template, m.label, len(m.w) AS length, d.i - 1 AS p, m.i - 1 AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d) AS d JOIN (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM m) AS m ON {run}),
votes AS (SELECT r, template, label, length, p - t AS diagonal, count(*) AS n FROM hits GROUP BY ALL),
peaks AS (SELECT r, template, diagonal, -(CASE WHEN length >= {LONG} THEN max({{'n': n, 'd': -diagonal}}) OVER (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN {FAR} PRECEDING AND {FAR} FOLLOWING)
  ELSE max({{'n': n, 'd': -diagonal}}) OVER (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) END).d AS peak FROM votes),
covers AS (SELECT h.r, h.template, h.label, h.length, k.peak, h.p, h.p + o AS pw, h.t + o AS tw FROM hits AS h JOIN peaks AS k ON h.r = k.r AND h.template = k.template AND h.p - h.t = k.diagonal, range({K}) AS x(o)),
spans AS (SELECT r, template, label, length, peak, least(count(DISTINCT tw), count(DISTINCT pw)) AS covered, min(p) AS a, max(pw) + 1 AS b FROM covers GROUP BY ALL),
verified AS (SELECT *, covered / greatest(length, b - a)::DOUBLE AS score FROM spans WHERE 100 * covered >= 75 * greatest(length, b - a)),
claims AS (SELECT *, {{'s': score, 'l': length, 'x': -template}} AS mine, unnest(range(a, b)) AS word FROM verified),
won AS (SELECT *, mine = max(mine) OVER (PARTITION BY r, word) AS best FROM claims),
kept AS (SELECT r, label, score FROM won GROUP BY r, template, label, a, b, score HAVING 2 * count(*) FILTER (best) >= b - a),
found AS (SELECT r, list(DISTINCT label) AS own, max(score) AS best FROM kept GROUP BY r),
rows AS (SELECT r, doc_id, len(w) AS n_words, {place} AS places, [x FOR x IN [{base}] IF x IS NOT NULL] AS base FROM d)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels, greatest(coalesce(best, 0), CASE WHEN len(places) > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM rows LEFT JOIN found USING (r)
"""


OP11_SQL = _sql()

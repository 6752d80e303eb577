"""License scans by diagonal voting, in DataFrame operations only.

Every text is lower-cased and cut into words; every two words in a row are hashed and joined to the places of the
same two words in the license templates (a fixed table of some hundred rows, so it is broadcast; the words themselves
are compared after the hash). A hit votes for the diagonal `place in text - place in template`. On one diagonal, as
many different votes as the template has word pairs mean that the whole template stands there word for word. For the
longer templates, other diagonals at most NEAR apart are merged, so that a passage with words put in or left out still
counts, and the span is verified by the share of the template's word pairs that it holds, in a span of text not much
longer than the template.

A text's votes are few, and only they are shuffled; words and texts stay where they are read.

Defined cases: a null text is empty: no words, no labels, score 0. Rows that repeat get a row each with the same
values. A null id is a key like others. Other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of well-known licenses, and labels.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "gnu lesser general public license": "lgpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Diagonals this far apart are merged; the share of a sentence's word pairs that verifies a span.
NEAR, LEAST_SHARE = 3, 0.8
#: A word: a run of digits, a-z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, str, int, bool]]:
    """(number, words, label, word pairs, whether a base phrase)."""
    rows = [(t, label, True) for t, label in BASE.items()] + [(t, label, False) for t, label in SENTENCES.items()]
    return [(i, text, label, len(text.split()) - 1, base) for i, (text, label, base) in enumerate(rows)]


def pairs() -> list[tuple[int, int, str, str, int, str, bool]]:
    """(template, place, first word, second word, pairs of the template, label, base) of every word pair."""
    return [(i, k, a, b, n, label, base) for i, text, label, n, base in templates() for k, (a, b) in enumerate(zip(text.split()[:-1], text.split()[1:], strict=True))]


def words_of(text: Column) -> Column:
    # lower() beyond A-Z turns no other character into a letter of a template (U+212A alone gives an ASCII letter, k) and no word character into another
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def votes(docs: DataFrame) -> DataFrame:
    """Every (row key, template, diagonal, place in the template) at which a text and a template have the same two words."""
    spark = docs.sparkSession
    table = spark.createDataFrame(pairs(), "template int, place int, a string, b string, n_pairs int, label string, base boolean")
    table = table.withColumn("hash", F.xxhash64("a", "b"))
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    grams = words.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "w1")).select("doc_id", "text_hash", "pos", "w1", F.get("w", F.col("pos") + 1).alias("w2"))
    hits = grams.join(F.broadcast(table), F.xxhash64("w1", "w2") == F.col("hash")).where((F.col("w1") == F.col("a")) & (F.col("w2") == F.col("b")))
    return hits.select("doc_id", "text_hash", "template", "n_pairs", "label", "base", "place", (F.col("pos") - F.col("place")).alias("diagonal"))


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: (doc_id, text_hash, label, base, exact places, start, end, score)."""
    per = votes(docs).groupBy("doc_id", "text_hash", "template", "n_pairs", "label", "base", "diagonal").agg(F.collect_set("place").alias("places"))
    # NEAR is 0 for base phrases: each place stands for itself
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    near = F.when(F.col("base"), 0).otherwise(NEAR)
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True))
    grouped = per.withColumn("group", F.sum(fresh.cast("int")).over(order))
    # a diagonal that holds the whole template is a span by itself, however long the chain that it stands in
    grouped = grouped.withColumn("whole", F.when(F.size("places") == F.col("n_pairs"), F.col("diagonal")))
    merged = grouped.groupBy("doc_id", "text_hash", "template", "n_pairs", "label", "base", "group", "whole").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("held"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places") + 1).alias("end"),
    )
    scored = merged.withColumn("score", F.size("held") / F.col("n_pairs"))
    short = F.col("end") - F.col("start") <= 2 * F.col("n_pairs") + 2
    return scored.where(F.when(F.col("base"), F.size("held") == F.col("n_pairs")).otherwise((F.col("score") >= LEAST_SHARE) & short)).drop("held", "group", "whole")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    docs = docs.select("doc_id", "text")
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    by_text = spans(docs).groupBy(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("__base"),
        F.collect_set("label").alias("__all"),
        F.max("score").alias("__score"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD)).cast("long").alias("n_words"))
    both = counted.join(by_text, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("text_hash") == F.col("__h")), "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined(F.col("__base")).alias("base_labels"),
        joined(F.col("__all")).alias("labels"),
        F.coalesce("__score", F.lit(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The same rows in DuckDB's SQL."""
    rows = ", ".join(f"({i}, {k}, '{a}', '{b}', {n}, '{label}', {str(base).lower()})" for i, k, a, b, n, label, base in pairs())
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH pairs(template, place, a, b, n_pairs, label, base) AS (VALUES {rows}),
texts AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
-- whole templates: their words stand in the text one after the other
phrases(words, n_pairs, label, base) AS (SELECT list(a ORDER BY place) || [max_by(b, place)], any_value(n_pairs), any_value(label), any_value(base) FROM pairs GROUP BY template),
whole AS (SELECT r, base, label, pos FROM texts, phrases, unnest(range(len(w) - n_pairs)) AS u(pos) WHERE list_contains(w, words[1]) AND w[pos + 1] = words[1] AND w[pos + 1 : pos + 1 + n_pairs] = words),
-- others: what is left of the template's word pairs on diagonals near one another
grams AS (SELECT r, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2, unnest(range(len(w) - 1)) AS pos FROM texts WHERE len(w) > 1),
per AS (SELECT r, template, n_pairs, label, pos - place AS diagonal, list(DISTINCT place) AS places FROM grams JOIN pairs ON w1 = a AND w2 = b WHERE NOT base GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {NEAR} OR lag(diagonal) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM per WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS g FROM marked),
merged AS (SELECT r, n_pairs, label, len(list_distinct(flatten(list(places)))) / n_pairs AS score, min(diagonal + list_min(places)) AS s, max(diagonal + list_max(places) + 1) AS e FROM grouped WHERE len(places) < n_pairs GROUP BY r, template, n_pairs, label, g),
spans AS (SELECT r, base, label, pos AS s, 1.0 AS score FROM whole UNION ALL SELECT r, false, label, s, score FROM merged WHERE score >= {LEAST_SHARE} AND e - s <= 2 * n_pairs + 2),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS f, max(s) FILTER (base) AS l, list(DISTINCT label) FILTER (base) AS bl, list(DISTINCT label) AS al, max(score) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels, coalesce(array_to_string(list_sort(al), ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM texts LEFT JOIN found USING (r)
"""

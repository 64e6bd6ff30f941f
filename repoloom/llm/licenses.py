"""License scans by diagonal voting, in DataFrame operations alone.

Every word k-gram of every text is hashed and joined to the positions of the same k-grams in
the templates. A hit votes for the diagonal (word position minus template position). Votes
are counted by diagonal; diagonals of a template at most `slack` apart are one span with words
put in or left out, and a span counts if it covers the `least` share of its template. Hits
are verified word by word right at the join, so equal hashes of other words never vote.

Words are runs of 0-9, a-z and characters above U+007F, with A-Z lower-cased. Null and empty texts
have no words. Rows that repeat an id and a text get the same result each; rows of one id with
different texts are scanned apart. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from repoloom.llm.common import text_key

# Phrases that are counted wherever their words stand (label, words).
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Opening sentences of public licenses, matched with gaps (label, words).
TEXTS = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
SEED_WORDS = 2  #: words whose hash is joined
TEXT_WORDS = 4  #: words of a vote for a longer text; a phrase's votes have SEED_WORDS
SLACK = 4
LEAST = 0.8


def words_of(text: Column) -> Column:
    # lower() maps one character to ASCII, the Kelvin sign; any other letter may stand for it
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("à")))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, grams): as many rows as there are templates above."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(PHRASES)).alias("phrase"), F.split(F.lit(text), " ").alias("tw")) for i, (label, text) in enumerate(PHRASES + TEXTS)]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    k = F.when(F.col("phrase"), SEED_WORDS).otherwise(TEXT_WORDS)
    return t.withColumn("k", k).withColumn("grams", F.size("tw") - F.col("k") + 1)


def seeds(spark: SparkSession) -> DataFrame:
    """(h, template, tpos, gram): one row per k-gram of a template, some two hundred in all."""
    t = templates(spark).select("template", "k", "tw", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("tpos"))
    gram = F.expr("slice(tw, tpos + 1, k)")
    return t.select(F.xxhash64(F.get("tw", F.col("tpos")), F.get("tw", F.col("tpos") + 1)).alias("h"), "template", "tpos", gram.alias("gram"))


def diagonals(docs: DataFrame) -> DataFrame:
    """(_id, _th, template, diagonal, at): template positions that voted for each diagonal."""
    words = docs.select(*text_key(), words_of(F.col("text")).alias("words"))
    hashes = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.xxhash64(a, b))
    grams = words.select("_id", "_th", "words", F.posexplode(hashes).alias("pos", "h"))
    found = grams.join(F.broadcast(seeds(docs.sparkSession)), "h").filter("slice(words, pos + 1, size(gram)) = gram")
    hits = found.select("_id", "_th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    return hits.groupBy("_id", "_th", "template", "diagonal").agg(F.collect_set("tpos").alias("at"))  # at most a template's length


def spans(diagonals: DataFrame, slack: int = SLACK) -> DataFrame:
    """(_id, _th, template, first, last, coverage, label, phrase): merged diagonals with the share of the template covered.

    A phrase's diagonals stay apart, because it may stand twice within `slack` words.
    """
    t = templates(diagonals.sparkSession)
    known = diagonals.join(F.broadcast(t), "template")
    w = Window.partitionBy("_id", "_th", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(w)
    group = F.sum(F.when(gap.isNull() | F.col("phrase") | (gap > slack), 1).otherwise(0)).over(w)
    merged = known.withColumn("_group", group).groupBy("_id", "_th", "template", "label", "phrase", "grams", "_group")
    out = merged.agg(
        F.min(F.col("diagonal") + F.array_min("at")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("at") + F.col("k") - 1).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"),
    )
    return out.withColumn("coverage", F.col("covered") / F.col("grams"))


def scan(docs: DataFrame, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, the places of phrases, labels, score and spans."""
    good = spans(diagonals(docs), slack).filter((F.col("phrase") & (F.col("coverage") == 1)) | (~F.col("phrase") & (F.col("coverage") >= least)))
    base = F.when(F.col("phrase"), F.col("first").cast("long"))
    found = good.groupBy("_id", "_th").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"),
        F.max("coverage").alias("score"),
        F.count(F.when(~F.col("phrase"), 1)).alias("n_texts"),
    )
    rows = docs.select("doc_id", *text_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return rows.join(found, ["_id", "_th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).cast(T.DoubleType()).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values() -> str:
    rows = [f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, string_split('{text}', ' '))" for i, (label, text) in enumerate(PHRASES + TEXTS)]
    return ", ".join(rows)


#: The same by comparing words themselves.
OP2_SQL = f"""
WITH t AS (SELECT *, CASE WHEN phrase THEN {SEED_WORDS} ELSE {TEXT_WORDS} END AS k FROM (VALUES {_values()}) v(template, label, phrase, tw)),
g AS (SELECT template, label, phrase, k, len(tw) - k + 1 AS grams, p AS tpos, list_slice(tw, p + 1, p + k) AS gram
      FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS p FROM t)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM d),
q AS (SELECT doc_id, pos, words[pos + 1] AS w1, list_slice(words, pos + 1, pos + 2) AS g2, list_slice(words, pos + 1, pos + 4) AS g4 FROM p),
h AS (SELECT doc_id, template, label, phrase, k, grams, pos - tpos AS diagonal, tpos FROM q JOIN g ON q.w1 = g.gram[1] AND g.gram = CASE WHEN g.phrase THEN g2 ELSE g4 END),
a AS (SELECT doc_id, template, label, phrase, k, grams, diagonal, list(DISTINCT tpos) AS votes FROM h GROUP BY ALL),
b AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS gap FROM a),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR phrase OR gap > {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM b),
s AS (SELECT doc_id, label, phrase, min(diagonal + list_min(votes)) AS first, len(list_distinct(flatten(list(votes)))) / grams AS coverage FROM c GROUP BY doc_id, template, label, phrase, grams, grp),
f AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
      FROM s WHERE (phrase AND coverage = 1) OR (NOT phrase AND coverage >= {LEAST}) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f USING (doc_id)
"""

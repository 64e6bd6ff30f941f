"""Odd tables: clashing columns, repeated rows and ids, nulls, ties, very long texts, empty tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repoloom.llm import embedding_dedup, licenses, packing, replies, simhash, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def clashing(df, *names):
    """`df` with columns of these names, in front and with values of another type."""
    return df.select(*(F.lit("clash").alias(n) for n in names), *df.columns)


def test_trees_with_repeats_ties_and_clashes(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "c", 1.0), (1, 2, 1, "assistant", "b", 1.0)]
    rows += [(2, 1, None, "user", "tie", 0.0), (2, 2, 1, "assistant", "x", 3.0), (2, 3, 1, "assistant", "y", 3.0)]
    df = spark.createDataFrame(rows, MESSAGES)
    names = ("depth", "total", "up", "known", "leaf", "rank", "turn", "mean", "formatted", "loss", "count")

    def told(messages):
        got = replies.conversations(messages).withColumn("back", replies.read_turns(F.col("formatted"))).collect()
        return {r.tree: [(t.role, t.text) for t in r.back] for r in got}

    plain = told(df)
    assert plain == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "tie"), ("assistant", plain[2][1][1])]}
    assert told(clashing(df, *names)) == plain == told(df.orderBy(F.desc("text")))
    assert replies.conversations(df.limit(0)).count() == 0


def test_conversations_without_an_id(spark):
    rows = [(None, 1, "user", "one"), (None, 0, "assistant", None), (3, 5, None, ""), (3, 5, None, ""), (3, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in replies.conversations(replies.chain(clashing(df, "tree", "node", "parent", "score"))).withColumn("back", replies.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[-(2**63)].back] == [("assistant", ""), ("user", "one")]
    assert [(t.role, t.text) for t in got[3].back] == [("assistant", "first"), ("", ""), ("", "")]
    assert replies.conversations(replies.chain(df.limit(0))).count() == 0


@pytest.mark.parametrize("words", [0, 1, 200_000])
def test_long_texts_and_empty_ones(spark, words):
    rnd = random.Random(words)
    text = " ".join(rnd.choice("río stone the Quick it's 12".split()) for _ in range(words))
    docs = clashing(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"), "fp", "part", "before", "ids", "u", "v", "root")
    ids = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids + [0]
    pieces = sorted(packing.pack(docs, BYTE_BPE, 0).filter("doc_id = 2").collect(), key=lambda r: r.start)
    assert [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()] == ids and all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    assert {r.doc_tokens for r in pieces} == {len(ids)} and [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {1: (simhash.fingerprint(text) & (2**64 - 1), 1), 2: (simhash.fingerprint(text) & (2**64 - 1), 1), 3: (0, 3 if words else 1)}


def test_licenses_with_ties_repeats_and_clashes(spark):
    both = "mit license mit license apache license gnu general public license"
    rows = [(1, both), (1, both), (1, "cc by cc by"), (None, "MIT\x00LICENSE"), (2, ""), (3, ("the " * 50_000) + "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(map(str, (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score))) for r in licenses.scan(df).collect())
    want = [("1", 10, 4, 0, 6, "apache,gpl,mit", 1.0)] * 2 + [("1", 4, 2, 0, 2, "cc-by", 1.0), ("None", 2, 1, 0, 0, "mit", 1.0), ("2", 0, 0, None, None, "", 0.0), ("3", 50_002, 1, 50_000, 50_000, "cc-by", 1.0)]
    assert got == sorted(tuple(map(str, w)) for w in want)
    odd = clashing(df, "n_words", "first", "last", "phrase", "template", "diagonal", "coverage", "label", "h", "at", "gram")
    assert sorted(map(str, licenses.scan(odd).collect())) == sorted(map(str, licenses.scan(df).collect()))


def test_toxicity_with_labels_that_clash_and_repeat(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    plain = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    odd = clashing(labels, "text", "lang", "source", "word", "n", "held_out")
    again = {r.doc_id: r.score for r in toxicity.score(clashing(docs, "toxic", "held_out", "score"), toxicity.learn(clashing(docs, "toxic", "held_out", "score"), odd)).collect()}
    assert again == plain and set(plain) == {r.doc_id for r in docs.collect()} and all(0 <= s <= 1 for s in plain.values())
    nulls = labels.unionByName(spark.createDataFrame([(None, None, 1), (1, None, None)], "doc_id long, quality int, toxic int").select(*(F.col(c).cast(labels.schema[c].dataType) for c in labels.columns)))
    toxicity.learn(docs, nulls)


def test_vectors_with_clashes_repeats_and_ties(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [0.0, 1.0], 2), (9, [1.0, 0.001], 1), (10, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    odd = clashing(df, "cls", "x", "rep", "copies", "a", "b", "near", "shard", "_norm")
    for table in (df, odd):
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()), key=str)
        assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (7, 0, 7), (8, 0, 8), (9, 3, 5), (10, 0, 10)], key=str)

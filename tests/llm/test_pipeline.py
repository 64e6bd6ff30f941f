"""The pipeline on a small corpus with planted cases, and its stages on odd tables."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from repoloom.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklm", k=rnd.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """Clean, toxic, copied, contaminated documents, a shared passage, and rows without text or id."""
    rnd, at = random.Random(9), tmp_path_factory.mktemp("corpus")
    shared, item = prose(rnd, 60), prose(rnd, 30)
    texts = {i: prose(rnd, 80) for i in range(120)}
    for i in range(0, 60, 2):
        texts[i] = " ".join(w if k % 9 else rnd.choice(["idiotic", "worthless"]) for k, w in enumerate(texts[i].split()))
    texts[200], texts[201], texts[202] = texts[61], texts[63], texts[61]
    texts[203], texts[204] = f"{prose(rnd, 40)} {shared} {prose(rnd, 30)}", f"{prose(rnd, 50)} {shared} {prose(rnd, 20)}"
    texts[205] = f"{prose(rnd, 30)} {item} {prose(rnd, 30)}"
    texts |= {206: None, 207: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(65, texts[65], "en", "s", 1), (None, prose(rnd, 50), None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60 and i % 2 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts, shared


def test_run(spark, home):
    at, texts, shared = home
    got = corpus_pipeline.run(spark, at).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {*range(0, 60, 2)} and ids >= {*range(1, 60, 2), *range(60, 120), 203, 204, None}
    assert not ids & {200, 201, 202, 205} and len(ids & {206, 207}) == 1
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for r in got:
        pieces[r.doc_id] += r.length
    for i in (1, 61, 65, 119):  # whole documents, once
        assert pieces[i] == len(tok.encode(texts[i], add_special_tokens=False).ids) + 1
    for i in (203, 204):  # the shared passage is gone
        assert pieces[i] < len(tok.encode(texts[i], add_special_tokens=False).ids) - len(tok.encode(shared, add_special_tokens=False).ids) * 0.9
    flat = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] * 1024 + a[1] + a[2] == b[0] * 1024 + b[1] for a, b in zip(flat, flat[1:]))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_on_odd_tables(spark, home, stage):
    at, _, _ = home
    name, run = stage
    long = prose(random.Random(1), 20_000)
    rows = [(None, None, None, None, None), (None, "", None, None, None), (1, long, "en", "s", 1), (2, "short", "en", "s", 5), (2, "short", "en", "s", 5), (2, "other words", None, None, None)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], f"{DOCS}, _th string, fp string, score string")
    out, none = run(spark, docs, at), run(spark, docs.filter(F.lit(False)), at)
    assert none.count() == 0
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {None, 1, 2}
        return
    got = out.collect()
    assert out.columns == docs.columns and {r.doc_id for r in got} == {None, 1, 2}
    assert [r.text for r in got if r.doc_id == 1] == [long] and any(r.text == "other words" for r in got)
    assert len(got) == (4 if name == "simhash_near_dedup" else 6)


def test_toxic_documents_go_and_clean_ones_stay(spark, home):
    at, texts, _ = home
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    clash = labels.withColumn("text", F.lit("clash")).withColumn("_th", F.lit(1))
    kept = {r.doc_id for r in toxicity.reject(docs, toxicity.learn(docs, clash)).collect()}
    assert kept == {None, *texts} - {*range(0, 60, 2)}

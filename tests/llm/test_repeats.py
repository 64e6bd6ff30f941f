"""Rows that repeat an id and a text, in suffix-array dedup and SimHash near-dedup."""

import hashlib
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from repoloom.llm import simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _th string"


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijk", k=rnd.randrange(2, 9))) for _ in range(n))


def test_rows_of_one_id_and_text_lose_everything(spark):
    rnd = random.Random(3)
    a, b, c = prose(rnd, 100), prose(rnd, 100), prose(rnd, 100)
    rows = [(None, a), (None, a), (None, b), (1, b + " x"), (2, c), (2, c + "y"), (3, "short"), (3, "short"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r._id if r._id > -(2**63) else None, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(None, len(a), 1, empty), (None, len(b), 1, empty), (1, len(b), 1, sha(" x")), (2, len(c), 1, empty), (2, len(c), 1, sha("y"))}
    cut = suffix_dedup.without_repeats(docs).collect()
    assert sorted((r.text or "") for r in cut) == sorted(["", "", "", " x", "", "y", "short", "short", "", ""])


def test_many_rows_of_one_key_take_linear_time(spark):
    rnd = random.Random(4)
    text = prose(rnd, 500)
    row = spark.createDataFrame([(text,)], "text string")

    def seconds(n):
        docs = row.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("n"), "text").select(F.lit(None).cast("long").alias("doc_id"), "text")
        start = time.perf_counter()
        assert [r.n_removed for r in suffix_dedup.removed(docs).collect()] == [len(text)]
        return time.perf_counter() - start

    seconds(10)
    assert seconds(100_000) < 60


@pytest.mark.parametrize("seed", [1, 2])
def test_one_document_of_each_group_stays(spark, seed):
    """By id and text: no copy stays because another text of its id does."""
    rnd = random.Random(seed)
    texts = [prose(rnd, 40) for _ in range(12)]
    rows = [(rnd.choice([None, *range(8)]), rnd.choice([*texts, None, ""]), "en", "s", 1, "clash") for _ in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.one_of_each(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", set()).add((doc_id is None, doc_id or 0))
    assert [g[:2] for g in sorted(got, key=lambda g: g[2])] == [min(groups[t]) for t in sorted(groups)]
    assert kept.columns == docs.columns and len(got) == len(groups)


def test_one_python_worker_for_a_task(spark):
    """Cutting and decoding are one pass: two chained ones keep two workers for each core of an executor."""
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    plan = suffix_dedup.without_repeats(docs)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2  # the merge across shards, behind an exchange of its own, and the cut


def test_a_shard_takes_few_bytes_for_each_of_its_own():
    rnd = random.Random(6)
    shared = [prose(rnd, 200).encode() for _ in range(20)]
    pieces = [prose(rnd, 400).encode() + rnd.choice(shared) for _ in range(300)]
    tracemalloc.start()
    try:
        starts = suffix_dedup.repeated_in_shard(pieces, 200)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, starts)) > 200_000 and most < 60 * sum(map(len, pieces))

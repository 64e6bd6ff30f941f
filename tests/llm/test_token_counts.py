"""Rollups against counting anew: any order of batches, ties, merged sets, and the registered query."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repoloom.llm import token_counts

SCHEMA = "seq long, op string, doc_id long, version string, source string, lang string, tokens long, batch string"


def recount(batches):
    """Totals of the last change of each document and version, by batch, seq, and the row itself."""
    least = lambda v: (v is not None, v if v is not None else 0)
    last = {}
    for batch in sorted(batches):
        for seq, op, doc, version, source, lang, tokens, _ in batches[batch]:
            if op in token_counts.OPS:
                place = (batch, least(seq), op, least(source), least(lang), tokens or 0)
                if (doc, version) not in last or last[doc, version][0] < place:
                    last[doc, version] = place, (source, lang, version), op, tokens or 0
    totals = defaultdict(lambda: [0, 0])
    for _, group, op, tokens in last.values():
        if op != "delete":
            totals[group][0] += 1
            totals[group][1] += tokens
    return {k: tuple(v) for k, v in totals.items()}


def totals(roll):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}


def some_batches(rnd, n):
    row = lambda: (
        rnd.choice([None, 1, 1, 2]), rnd.choice(["insert", "revise", "delete", "other", None]), rnd.choice([None, 1, 2, 3, 4]), rnd.choice(["v1", "v2", None]),
        rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice([None, 0, 5, 7]), "clash",
    )
    return {b: [row() for _ in range(rnd.choice([0, 3, 12]))] for b in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_equals_a_recount(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(token_counts, "COMPACT", 3)
    rnd = random.Random(seed)
    batches = some_batches(rnd, 7)
    order = list(batches)
    rnd.shuffle(order)
    roll, done = token_counts.Rollup(spark, str(tmp_path / "r")), {}
    assert totals(roll) == {}
    for k, batch in enumerate(order):
        rows = batches[batch]
        done[batch] = rows
        assert roll.commit(batch, spark.createDataFrame(rnd.sample(rows, len(rows)), SCHEMA))
        if k in (2, 6):
            assert not roll.commit(order[0], spark.createDataFrame(rows, SCHEMA))
            assert totals(roll) == recount(done)
    assert roll._complete("covers") and roll.batches() == sorted(batches)


def test_late_batches(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    for batch, op, tokens in ((0, "insert", 10), (2, "revise", 30), (1, "revise", 20), (3, "delete", None), (4, "insert", 5)):
        roll.commit(batch, spark.createDataFrame([(1, op, 1, "v", "s", "en", tokens, None)], SCHEMA))
    assert totals(roll) == {("s", "en", "v"): (1, 5)}


def test_a_broken_commit_is_written_anew(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    roll.commit(0, spark.createDataFrame([(1, "insert", 1, "v", "s", "en", 10, None)], SCHEMA))
    rows = spark.createDataFrame([(1, "revise", 1, "v", "t", "en", 4, None), (1, "insert", 2, "v", "t", "en", 6, None)], SCHEMA)
    roll.commit(1, rows)
    (tmp_path / "r" / "delta-1" / "_SUCCESS").unlink()
    assert totals(roll) == {("s", "en", "v"): (1, 10)} and roll.commit(1, rows)
    assert totals(roll) == {("t", "en", "v"): (2, 10)}


def test_query_equals_a_recount(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first = {}
    for r in docs:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    want = Counter()
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        tok = Tokenizer.from_file(public_tokenizers.path(f"{version}.json"))
        for r in docs:
            if r.text is None or first[r.text] == r.doc_id:
                text = r.text or ""
                while "  " in text:
                    text = text.replace("  ", " ")
                group = (r.source, r.lang, version)
                want[(*group, "docs")] += 1
                want[(*group, "tokens")] += len(tok.encode(text, add_special_tokens=False).ids)
    got = token_counts.op4_token_counts(spark, sf).collect()
    assert len(got) * 2 == len(want)
    assert all((want[(r.source, r.lang, r.version, "docs")], want[(r.source, r.lang, r.version, "tokens")]) == (r.n_docs, r.n_tokens) for r in got)

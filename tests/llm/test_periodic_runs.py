"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoloom.llm import periodic_runs

DOCS = "doc_id long, text string, start long, n_runs long, period string, doc string"


def plain_runs(words):
    """(start, end, period) of all runs: each lag in turn, the smallest period of a stretch stays."""
    names = {}
    a = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    out = {}
    for p in range(1, len(a) // 3 + 1):
        turn = np.diff(np.r_[0, (a[:-p] == a[p:]).astype(int), 0])
        for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + p):
            if e - s >= max(24, 3 * p):
                out.setdefault((int(s), int(e)), p)
    return sorted((s, e, p) for (s, e), p in out.items())


def plain_report(doc_id, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, e, p in runs for i in range(s + p, e)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (Fraction(r[0] - r[1], r[2]), r[0], r[2]), default=None)
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    told = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def odd_words(rnd, most):
    """Stretches of few letters, repeats with and without a rest, and words that double and flip themselves."""
    words = []
    while len(words) < most:
        kind = rnd.randrange(4)
        if kind == 0:
            words += [rnd.choice("abcdefghij") for _ in range(rnd.randrange(40))]
        elif kind == 1:
            unit = [rnd.choice("ab") for _ in range(rnd.randrange(1, 60))]
            words += (unit * rnd.randrange(1, 8))[: rnd.randrange(1, 300)]
        elif kind == 2:
            words += ["a"] * rnd.randrange(60)
        else:
            unit = ["a", "b"]
            for _ in range(rnd.randrange(1, 8)):
                unit = unit + (["b" if w == "a" else "a" for w in unit] if rnd.random() < 0.5 else unit)
            words += unit[:200] * rnd.randrange(1, 4)
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_the_plain_scan(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        texts = [[w.encode() for w in odd_words(rnd, rnd.randrange(700))] for _ in range(rnd.randrange(1, 10))]
        for words, got in zip(texts, periodic_runs.text_runs(texts)):
            assert [tuple(map(int, r)) for r in got] == sorted(plain_runs(words), key=lambda r: (r[0], r[2]))


def test_a_false_hash_is_scanned_again(monkeypatch):
    """With every hash equal, seeds are many and wrong; what is given is still a set of true runs."""
    monkeypatch.setattr(periodic_runs.Grams, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    words = [b"x%d" % i for i in range(50)] + [b"y%d" % (i % 11) for i in range(60)] + [b"z%d" % i for i in range(50)]
    assert [tuple(map(int, r)) for r in periodic_runs.text_runs([words])[0]] == [(50, 110, 11)]


def test_threshold_and_maximality():
    unit = [b"u%d" % i for i in range(10)]
    at = lambda words: [tuple(map(int, r)) for r in periodic_runs.text_runs([words])[0]]
    assert at(unit * 3) == [(0, 30, 10)] and at((unit * 3)[:29]) == []
    assert at([b"w"] * 23) == [] and at([b"w"] * 24) == [(0, 24, 1)]
    assert at(unit[3:] + unit * 3 + unit[:4] + [b"end"]) == [(0, 41, 10)]
    assert at([]) == [] and periodic_runs.text_runs([]) == []


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n\t\x0b ", "one", "a\u00a0b " * 30, " ".join(odd_words(rnd, 9000)), " ".join(f"w{i % 4000}" for i in range(13000))]
    texts += [" \r\n".join(odd_words(rnd, rnd.randrange(400))) for _ in range(60)]
    rows = [(i, t, 1, None, "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, texts[5], None, None, None, None)], DOCS).repartition(3).cache()


@pytest.mark.parametrize("plant", [False, True])
def test_report_equals_the_plain_one(docs, plant):
    got = periodic_runs.runs_report(docs, plant=plant).collect()
    want = [plain_report(r.doc_id, r.text, plant) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_runs_and_collapsed_text(spark, docs):
    rows = periodic_runs.runs_report(docs.filter("doc_id = 4"), with_runs=True).collect()
    assert [tuple(r) for r in rows[0].runs] == [(0, 30, 1)] and rows[0].collapsed == "a\u00a0b"
    assert periodic_runs.runs_report(docs.filter(F.lit(False)), with_runs=True).count() == 0


def test_query_equals_the_plain_report(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    assert got == {plain_report(r.doc_id, r.text, True) for r in docs.collect()} and sum(r[1] for r in got) > 5

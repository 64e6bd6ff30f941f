"""Hard negatives against comparing every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoloom.llm import hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int, row long, score string"


def plain(rows, every=100):
    """All answers as a sorted list, from Python integers."""
    held = []
    for at, (name, x, label, *_) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = [math.floor(256 * float(np.float32(v))) for v in x]
        if sum(v * v for v in q) < 2**62:
            held.append((at, name, label, q))
    out = []
    for at, name, label, q in held:
        if name is None or name % every:
            continue
        near = [(-sum(a * b for a, b in zip(q, o[3])), math.inf if o[1] is None else o[1], o[2] == label) for o in held if o[0] != at and len(o[3]) == len(q)]
        for p, p_id, _ in sorted(n for n in near if n[2])[:5]:
            hard = sorted(n for n in near if not n[2] and 30 * -p <= 100 * -n[0] <= 90 * -p)[:10]
            out += [(name, p_id, k, n_id, -p, -n) for k, (n, n_id, _) in enumerate(hard, 1)]
    return sorted(tuple(None if v == math.inf else v for v in r) for r in out)


def some_vectors(seed, n=1500, dim=12):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(40, dim))
    rows = []
    for i in range(n):
        x = base[rnd.integers(40)] + rnd.normal(size=dim) * 0.4
        rows.append((i, (x * rnd.choice([0.01, 0.3, 1.0, 30.0])).astype(np.float32).tolist(), int(rnd.integers(4)) if rnd.random() < 0.6 else 9, i, "clash"))
    return rows


def answers(spark, rows, is_anchor=None):
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("id") % 100 == 0 if is_anchor is None else is_anchor)
    return sorted(tuple(r) for r in got.collect())


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize(("seed", "window", "block", "share"), [(1, 512, 8 << 20, 16), (2, 32, 1500, 2), (3, 7, 400, 3)])
def test_equals_comparing_all(spark, monkeypatch, seed, window, block, share):
    monkeypatch.setattr(hard_negatives, "WINDOW", window)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "FLOOR_SHARE", share)
    monkeypatch.setattr(hard_negatives, "HELD", 200)
    rows = some_vectors(seed, 1500 if window > 7 else 400)
    want = plain(rows)
    assert answers(spark, rows) == want and len(want) > 30


def test_odd_rows(spark):
    rows = some_vectors(4, 300)
    x = rows[5][1]
    rows += [(300, x, 9, 0, None), (300, x, 9, 0, None), (400, None, 1, 0, None), (500, x, None, 0, None), (600, [*x[:-1], None], 1, 0, None)]
    rows += [(700, [*x[:-1], float("nan")], 1, 0, None), (800, [*x[:-1], float("-inf")], 1, 0, None), (900, [0.0] * 12, 1, 0, None), (1000, [3e38] * 12, 1, 0, None)]
    rows += [(1100, [], 1, 0, None), (1101, [], 1, 0, None), (1102, [], 2, 0, None), (1200, [1.0, 2.0], 1, 0, None), (1201, [2.0, 4.0], 1, 0, None), (1202, [1.0, 2.0], 2, 0, None), (1203, [1.0, 1.0], 2, 0, None)]
    rows += [(None, x, 3, 0, None), (None, x, 9, 0, None), *((2000 + i, x, i % 3, 0, None) for i in range(40)), (-100, x, 2, 0, None)]
    want = plain(rows)
    assert key(answers(spark, rows)) == key(want)
    assert {r[0] for r in want} >= {300, -100, 1100, 1200} and not {400, 500, 600, 700, 800, 1000} & {r[0] for r in want}


def test_wide_scores_stay_exact(spark):
    rnd = np.random.default_rng(6)
    for scale in (3.0, 2000.0, 2e6):  # sums up to 2^24, 2^53 and beyond
        rows = [(i, (rnd.normal(size=6) * scale).astype(np.float32).tolist(), i % 2, 0, None) for i in range(300)]
        assert answers(spark, rows) == plain(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("id") % 100 == 0).count() == 0
    rows = spark.createDataFrame(some_vectors(7, 50), VECTORS)
    assert hard_negatives.mine(rows, F.col("id") < 0).count() == 0


def test_bounds_hold_every_score():
    rnd = np.random.default_rng(8)
    for dim in (2, 3, 8):
        q = np.floor(rnd.normal(size=(400, dim)) * rnd.choice([1, 50, 3000], size=(400, 1)))
        q[7] = 0
        norm = np.sqrt((q * q).sum(1))
        angles = hard_negatives.angles_to(q, norm, hard_negatives.choose_directions(q, norm, 5))
        order = np.argsort(angles.min(1))
        tight = 0
        for i in range(0, 400, 20):
            w = order[i : i + 20]
            low, high = hard_negatives.score_bounds(angles, norm, [norm[w].min(), norm[w].max()], angles[w].min(0), angles[w].max(0))
            s = q @ q[w].T
            assert (low <= s.min(1)).all() and (high >= s.max(1)).all()
            tight += (high < (norm * norm[w].max()) * 0.7).sum()
        assert dim > 3 or tight > 0


def test_query_equals_sql_and_comparing_all(spark, sf):
    at = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    got = hard_negatives.op11_hard_negatives(spark, at).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == plain(rows)

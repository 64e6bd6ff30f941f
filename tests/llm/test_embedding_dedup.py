"""Shards, counts and forests of embedding near-dedup against brute force, on one label with a hot group."""

import sys

import numpy as np
import pandas as pd
import pytest

from repoloom.llm import embedding_dedup
from repoloom.llm.common import stored


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST", 60)
    monkeypatch.setattr(embedding_dedup, "FAN", 8)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 200)


@pytest.fixture(scope="module")
def vectors(spark):
    """600 vectors of one label: groups of neighbours, a third in one tight group, and one direction in 70 lengths."""
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(120, 12))
    x = base[rnd.integers(0, 120, 330)] + rnd.normal(size=(330, 12)) * 0.25
    tight = base[0] + rnd.normal(size=(200, 12)) * 0.1
    lengths = base[1] * np.arange(1, 71)[:, None]
    x = np.concatenate([x, tight, lengths]).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def truth(x):
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= embedding_dedup.COSINE
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        low = np.where(link, root[None, :], len(x)).min(1)
        new = np.minimum(root, low)
        if (new == root).all():
            return link, root
        root = new


def test_hot_label_against_brute_force(spark, vectors, small_shards):
    x, table = vectors
    link, root = truth(x)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert len(got) == len(x)
    counted = np.array([got[i].n_links for i in range(len(x))])
    assert (counted <= link.sum(1)).all() and counted.sum() >= 0.95 * link.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) >= 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_two_homes_no_pairs_and_exact_at_the_end(vectors, small_shards):
    x, table = vectors
    link, _ = truth(x)
    known = stored(embedding_dedup.classes(table))
    members, levels = embedding_dedup.shards(known)
    homes = [r["count"] for r in members.groupBy("cls").count().collect()]
    assert len(levels) > 1 and len(homes) == 600 and max(homes) <= 2
    assert max(r["count"] for r in members.groupBy("shard").count().collect()) <= 60
    graph = members.groupBy("shard").applyInPandas(embedding_dedup.build, "cls long, near array<long>")
    graph = stored(graph.selectExpr("cls", "explode(near) as n").groupBy("cls").agg({"n": "collect_set"}).toDF("cls", "near"))
    found = embedding_dedup.search(known, members, graph, levels, float("inf"), 180.0, embedding_dedup.COSINE)
    counted = dict(found.filter("kind = 0").groupBy("a").sum("b").collect())
    rep = {r.cls: r.rep for r in known.select("cls", "rep").collect()}
    assert {rep[c]: n for c, n in counted.items()} == {i: n for i, n in enumerate(link.sum(1).tolist()) if n}
    assert embedding_dedup.audit(known, found) == 1.0
    tasks = members.select("shard").distinct().count() * 3  # 600 queries in parts of 200
    assert found.filter("kind = 1").count() <= members.count() * 3 + tasks * 200 < link.sum()


def test_points_and_queries_take_their_steps_side_by_side():
    """A handful of calls for each point and query, whatever the graph's degree; the exact search finds what brute force does."""
    rnd = np.random.default_rng(5)
    x = np.repeat(rnd.normal(size=(300, 16)), 3, axis=0) + rnd.normal(size=(900, 16)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    names = np.sort(rnd.permutation(5000)[:900])
    none = [np.zeros(0, np.int64)] * 900
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        graph = embedding_dedup.build(pd.DataFrame({"cls": names, "x": list(x)}))
        members = graph.assign(x=list(x), copies=1, home=7, homes=[np.array([7])] * 900)
        queries = pd.DataFrame({"cls": names, "x": list(x), "before": none, "now": [np.array([7])] * 900})
        found = embedding_dedup._search(embedding_dedup.BEAM, embedding_dedup.COSINE)(queries, members)
    finally:
        sys.setprofile(None)
    link = x @ x.T >= embedding_dedup.COSINE
    np.fill_diagonal(link, False)
    got = dict(found[found.kind == embedding_dedup.COUNT][["a", "b"]].to_numpy().tolist())
    assert sum(got.values()) >= 0.95 * link.sum() > 500 and calls < 300 * 900
    exact = embedding_dedup._search(float("inf"), embedding_dedup.COSINE)(queries, members)
    got = dict(exact[exact.kind == embedding_dedup.COUNT][["a", "b"]].to_numpy().tolist())
    assert got == {int(n): int(k) for n, k in zip(names, link.sum(1)) if k}
    assert (exact[exact.kind == embedding_dedup.EDGE]["a"] > exact[exact.kind == embedding_dedup.EDGE]["b"]).all()

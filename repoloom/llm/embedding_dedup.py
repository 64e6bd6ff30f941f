"""Near-duplicate embeddings by robust-pruned flat graphs on overlapping shards.

1. Vectors of one label and dimension, equal ones once, are dealt to shards of about `MOST` / 2. At most `FAN` vectors of a
   larger shard (chosen by a hash, the bounded sample the index is fitted on) are centres, and every vector goes to its nearest
   one; at the last level expected it goes to its two nearest. So a vector has one or two homes, however many levels there are.
   Vectors that lie on top of each other are told apart by a small number drawn from their names, so that every level divides
   them. Every vector is indexed.
2. Each shard builds a graph: candidates are the `POOL` nearest members and some random ones, and
   robust pruning keeps one only if no kept neighbour is `ALPHA` times nearer to it. The
   lists that a vector has in its two shards are united.
3. Every vector is a query in all shards whose centre is at most `SLACK` degrees farther than its nearest one.
   A greedy search starts from the shard's medoid, at home from the vector itself too; then everything within reach of the threshold is expanded
   until nothing new is found. Where that meets a vector whose other home the query hasn't seen, the search goes on there in the
   next round, so that it follows the united lists across shards; rounds end when no query has a shard left.
   Hot shards are searched by several tasks, each with a part of the queries. `BLOCK` points or queries of a task take their steps
   side by side; the walk reads vectors in single precision.
4. Cosines in double precision verify every pair. Pairs aren't given out: a task adds up the links of each query, each pair in the
   first shard where the query meets the other vector, and keeps a spanning forest of its links. `audit` compares a bounded sample
   of queries with brute force; `links` searches again with twice the beam and slack while recall is below `RECALL`, and the last
   time in all shards with a beam without end, which misses nothing.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do rows without a
label. Copies link with each other. A null vec_id is counted and keeps a null component unless it links. Rows that repeat a
vec_id are vectors of their own and link like copies; equal cosines need no order, since every pair at the threshold counts.
Columns other than vec_id, embedding and label are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.llm.common import stored
from repoloom.llm.components import components, union_roots

COSINE = 0.93
MOST, FAN, LEVELS = 3000, 256, 12
TIES = 0.01  # degrees
POOL, FAR, DEGREE, ALPHA = 64, 8, 24, 1.2
BEAM, SLACK = 24, 2.0
QUERIES = 4000
BLOCK = 128  # points or queries that a task takes at once
HELD = 1 << 20  # links held by a task before they become a forest
AUDIT, RECALL = 500, 0.95


def classes(vectors: DataFrame) -> DataFrame:
    """(cls, label, x array<double> of length 1, rep, copies, embedding): valid vectors, equal ones once."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    ok = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn("_norm", norm).filter("_norm > 0")
    one = ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("_norm").alias("_norm"))
    return one.select(F.xxhash64("label", "embedding").alias("cls"), F.concat_ws("/", "label", F.size("embedding")).alias("label"), F.transform("embedding", lambda v: v.cast("double") / F.col("_norm")).alias("x"), "rep", "copies")


def _draws(cls: np.ndarray, n: int) -> np.ndarray:
    """Numbers from 0 to 1, the same whenever a task is tried again: one row per name, n columns."""
    with np.errstate(over="ignore"):
        z = cls.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(31))) / 2.0**64


def _angles(rows: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
    centers = np.stack(list(held["centers"].iloc[0]))
    return np.degrees(np.arccos(np.clip(np.stack(rows["x"].to_list()) @ centers.T, -1, 1)))


def _moved(rows: pd.DataFrame, row: np.ndarray, to: np.ndarray, **more) -> pd.DataFrame:
    out = rows.drop(columns=["part"]).iloc[row].copy()
    out["shard"] = [f"{s}.{k}" for s, k in zip(out["shard"], to)]
    return out.assign(**more)


def _deal(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Members of a shard to the nearest centre, or to the two nearest."""
    angle = _angles(rows, held)
    angle += TIES * _draws(rows["cls"].to_numpy(), angle.shape[1])
    wide = bool(held["wide"].iloc[0]) and not rows["doubled"].iloc[0]
    take = np.argsort(angle, 1, kind="stable")[:, : 2 if wide else 1]
    return _moved(rows, np.repeat(np.arange(len(rows)), take.shape[1]), take.ravel(), doubled=wide or bool(rows["doubled"].iloc[0]))


def _route(slack: float):
    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        angle = _angles(rows, held)
        return _moved(rows, *np.nonzero(angle <= angle.min(1, keepdims=True) + slack))

    return run


def _by_part(rows: DataFrame, held: DataFrame) -> tuple:
    """Rows in parts of about `QUERIES` of a shard, and what each part needs of the shard, both grouped."""
    parts = rows.join(held.select("shard").distinct(), "shard", "left_semi").groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    dealt = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
    copied = held.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("shard", "part"), copied.groupBy("shard", "part")


def _split(rows: DataFrame, centers: DataFrame, run) -> DataFrame:
    """Rows of shards with centres moved by `run`, others as they are."""
    dealt, held = _by_part(rows, centers)
    return rows.join(centers.select("shard"), "shard", "left_anti").select(rows.columns).union(dealt.cogroup(held).applyInPandas(run, rows.schema))


def shards(vectors: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((cls, x, shard, doubled) members, the centres of each level as (shard, centers, wide))."""
    members = stored(vectors.select("cls", "x", F.col("label").alias("shard"), F.lit(False).alias("doubled")))
    levels: list[DataFrame] = []
    wanted = F.ceil(F.col("n") * 4 / MOST)
    steps = F.greatest(F.ceil(F.log(wanted) / float(np.log(FAN))), F.lit(1))
    while True:
        large = members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > MOST)
        large = large.select("shard", F.ceil(F.pow(wanted, 1 / steps)).alias("k"), (steps == 1).alias("wide"))
        order = Window.partitionBy("shard").orderBy(F.xxhash64("cls", F.lit(5)), "cls")
        picked = members.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= FAN).join(large, "shard").filter("i <= k")
        centers = stored(picked.groupBy("shard").agg(F.collect_list("x").alias("centers"), F.first("wide").alias("wide")))
        if centers.isEmpty():
            return members, levels
        if len(levels) == LEVELS:
            raise RuntimeError(f"shards above {MOST} vectors are left after {LEVELS} levels")
        levels.append(centers)
        members = stored(_split(members, centers, _deal))


def prune(sims: np.ndarray, to: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which candidates of each point stay: candidates sorted from near to far, `to` their cosine with the point, `sims` among them.

    `left` marks the candidates that count, one row for each point."""
    left, kept, n = left.copy(), np.zeros(to.shape, bool), np.zeros(len(to), int)
    bar, gap = 1 - to, ALPHA * (1 - sims)
    for i in range(to.shape[1]):
        row = np.flatnonzero(left[:, i] & (n < DEGREE))
        kept[row, i] = True
        n[row] += 1
        left[row] &= gap[row, i] > bar[row]
    return kept


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build(df: pd.DataFrame) -> pd.DataFrame:
    """The shard's graph: (cls, near array of cls)."""
    df = df.sort_values("cls")
    x, names = np.stack(df["x"].to_list()), df["cls"].to_numpy()
    n = len(x)
    random = np.random.default_rng(n)
    m = min(POOL, n - 1)
    u, v = [], []
    for a in range(0, n if m else 0, BLOCK):
        s = x[a : a + BLOCK] @ x.T
        own = np.arange(a, a + len(s))[:, None]
        s[np.arange(len(s)), own[:, 0]] = -2
        c = np.concatenate([np.argpartition(-s, m - 1, axis=1)[:, :m], random.integers(0, n, (len(s), FAR))], axis=1)
        c.sort(axis=1)
        to = np.take_along_axis(s, c, 1)
        by = np.argsort(-to, axis=1, kind="stable")
        c, to = np.take_along_axis(c, by, 1), np.take_along_axis(to, by, 1)
        left = c != own
        left[:, 1:] &= c[:, 1:] != c[:, :-1]
        near = x[c]
        i, k = np.nonzero(prune(near @ near.transpose(0, 2, 1), to, left))
        u.append(a + i)
        v.append(c[i, k])
    u, v = (np.concatenate([np.zeros(0, np.int64), *w]) for w in (u, v))
    # what the medoid doesn't reach is tied to it
    top, root = medoid(x), np.arange(n)
    at, least = union_roots(u, v)
    root[at] = least
    tied = np.setdiff1d(root, root[top])
    pairs = np.unique(np.concatenate([u * n + v, v * n + u, top * n + tied]))
    return pd.DataFrame({"cls": names, "near": np.split(names[pairs % n], np.searchsorted(pairs, np.arange(1, n) * n))})


COUNT, EDGE, FURTHER = 0, 1, 2


def _near(x: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray, q: np.ndarray, itself: np.ndarray, start: int, beam: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of what greedy searches find within `reach`, by query; the queries take their steps side by side.

    A search starts from `start` and from the query itself. Of what a step meets, what is within reach or among the `beam` nearest
    met so far is expanded in the next one; what isn't then never will be, since the nearest only come nearer.
    """
    n = len(x)
    seen, fresh = np.zeros(len(q) * n, bool), np.zeros(len(q) * n, bool)
    fresh[np.arange(len(q)) * n + itself] = True
    fresh[np.arange(len(q)) * n + start] = True
    best = np.full((len(q), int(beam) if beam < n else 0), -np.inf)
    found = []
    while True:
        key = np.flatnonzero(fresh)
        if not len(key):
            break
        seen |= fresh
        fresh[:] = False
        row, met = np.divmod(key, n)
        sim = np.einsum("ij,ij->i", x[met], q[row])
        go = sim >= reach
        found.append(key[go])
        if not best.shape[1]:  # a beam that holds the whole shard
            go[:] = True
        else:
            near = np.flatnonzero(sim > best.min(1)[row])
            asks, count = np.unique(row[near], return_counts=True)
            at = best.shape[1] + np.arange(len(near)) - np.repeat(np.cumsum(count) - count, count)
            line = np.repeat(np.arange(len(asks)), count)
            all_ = np.full((len(asks), best.shape[1] + count.max(initial=0)), -np.inf)
            all_[:, : best.shape[1]] = best[asks]
            all_[line, at] = sim[near]
            if len(asks):
                top = np.argpartition(-all_, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
                best[asks] = np.take_along_axis(all_, top, 1)
                chosen = np.zeros(all_.shape, bool)
                np.put_along_axis(chosen, top, True, 1)
                go[near[chosen[line, at]]] = True
        row, met = row[go], met[go]
        k = size[met]
        fresh[np.repeat(row, k) * n + flat[np.repeat(first[met] - np.cumsum(k) + k, k) + np.arange(k.sum())]] = True
        fresh &= ~seen
    return np.divmod(np.sort(np.concatenate([np.zeros(0, np.int64), *found])), n)


def _search(beam: float, threshold: float):
    """Rows (kind, a, b): links of query a by weight, an edge of the forest, or a shard where query a goes on."""

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(members) or not len(queries):
            return none
        members = members.sort_values("cls")
        x, names, copies = np.stack(members["x"].to_list()), members["cls"].to_numpy(), members["copies"].to_numpy()
        lists = [np.asarray(v, np.int64) for v in members["near"]]
        size = np.array([len(v) for v in lists])
        owner, flat = np.repeat(np.arange(len(lists)), size), np.concatenate(lists)
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        here = names[at] == flat  # the others are met in their own homes
        flat, size = at[here], np.bincount(owner[here], minlength=len(names))
        first = np.cumsum(size) - size
        own = int(members["home"].iloc[0])
        other = np.array([next((h for h in v if h != own), own) for v in members["homes"]], np.int64)
        asked, q = queries["cls"].to_numpy(), np.stack(queries["x"].to_list())
        itself, start = np.minimum(np.searchsorted(names, asked), len(names) - 1), medoid(x)
        itself = np.where(names[itself] == asked, itself, start)
        short, short_q = x.astype(np.float32), q.astype(np.float32)
        out, u, v, waiting = [], [], [], 0
        for a in range(0, len(q), BLOCK):
            z = min(a + BLOCK, len(q))
            row, met = _near(short, flat, first, size, short_q[a:z], itself[a:z], start, beam, threshold - 0.03)
            linked = (np.einsum("ij,ij->i", x[met], q[a + row]) >= threshold) & (names[met] != asked[a + row])
            edges = np.searchsorted(row, np.arange(z - a + 1))
            for i in np.flatnonzero(np.diff(edges)):
                near, hit = met[edges[i] : edges[i + 1]], linked[edges[i] : edges[i + 1]]
                name, before, now = asked[a + i], queries["before"].iat[a + i], queries["now"].iat[a + i]
                further = set(other[near].tolist()).difference(before.tolist(), now.tolist())
                if further:
                    out.append((FURTHER, name, sorted(further)))
                if not hit.any():
                    continue
                hit = near[hit]
                known = other[hit]
                hit = hit[~(np.isin(known, before) | (np.isin(known, now) & (known < own)))]
                if len(hit):
                    out.append((COUNT, name, [copies[hit].sum()]))
                    u.append(np.full(len(hit), name))
                    v.append(names[hit])
                    waiting += len(hit)
                    if waiting > HELD:
                        u, v = ([w] for w in union_roots(np.concatenate(u), np.concatenate(v)))
                        waiting = 0
        if u:
            out += [(EDGE, a, [b]) for a, b in zip(*union_roots(np.concatenate(u), np.concatenate(v)))]
        if not out:
            return none
        many = [len(b) for _, _, b in out]
        return pd.DataFrame({
            "kind": np.repeat(np.array([k for k, _, _ in out], np.int32), many), "a": np.repeat(np.array([a for _, a, _ in out], np.int64), many),
            "b": np.concatenate([np.asarray(b, np.int64) for _, _, b in out]),
        })

    return run


def search(vectors: DataFrame, members: DataFrame, graph: DataFrame, levels: list[DataFrame], beam: float, slack: float, threshold: float) -> DataFrame:
    """(kind, a, b): weights of the links of `threshold` or more that the graphs lead to, and a forest that spans them."""
    home = F.xxhash64("shard").alias("home")
    homes = members.groupBy("cls").agg(F.collect_set(home).alias("homes"))
    held = stored(members.select("cls", "x", "shard", home).join(graph, "cls").join(homes, "cls").join(vectors.select("cls", "copies"), "cls"))
    names = members.select("shard", home).distinct()
    asked = vectors.select("cls", "x", F.col("label").alias("shard"))
    for centers in levels:
        asked = _split(asked, centers, _route(slack))
    asked = stored(asked.select("cls", "shard", home))
    before = vectors.select("cls", F.array().cast("array<long>").alias("before"))
    tables = []
    while True:
        now = asked.groupBy("cls").agg(F.collect_list("home").alias("now"))
        queries = asked.select("cls", "shard").join(now, "cls").join(before, "cls").join(vectors.select("cls", "x"), "cls")
        dealt, copied = _by_part(queries, held)
        made = stored(dealt.cogroup(copied).applyInPandas(_search(beam, threshold), "kind int, a long, b long"))
        tables.append(made.filter(F.col("kind") != FURTHER))
        more = made.filter(F.col("kind") == FURTHER).select(F.col("a").alias("cls"), F.col("b").alias("home")).distinct()
        before = stored(before.join(now, "cls", "left").select("cls", F.concat("before", F.coalesce("now", F.array().cast("array<long>"))).alias("before")))
        asked = stored(more.join(names, "home").select("cls", "shard", "home"))
        if asked.isEmpty():
            break
    every = tables[0]
    for made in tables[1:]:
        every = every.union(made)
    return every


def audit(vectors: DataFrame, found: DataFrame, threshold: float = COSINE, size: int = AUDIT) -> float:
    """Share of the true links of `size` queries (smallest hashes of their ids) that `found` counts; 1 if there are none."""
    sample = stored(vectors.select("cls", "label", "x").orderBy(F.xxhash64("cls", F.lit(9)), "cls").limit(size))
    chosen = sample.collect()
    by_label: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for label in {r["label"] for r in chosen}:
        rows = [r for r in chosen if r["label"] == label]
        by_label[label] = (np.array([r["cls"] for r in rows]), np.array([r["x"] for r in rows]))

    def brute(batches):
        for df in batches:
            total = 0
            for label, part in df.groupby("label"):
                if label in by_label:
                    names, q = by_label[label]
                    linked = (q @ np.stack(part["x"].to_list()).T >= threshold) & (names[:, None] != part["cls"].to_numpy())
                    total += int((linked * part["copies"].to_numpy()).sum())
            yield pd.DataFrame({"n": [total]})

    true = vectors.select("cls", "label", "x", "copies").mapInPandas(brute, "n long").agg(F.sum("n")).first()[0]
    got = found.filter(F.col("kind") == COUNT).join(sample.select(F.col("cls").alias("a")), "a", "left_semi").agg(F.sum("b")).first()[0]
    return (got or 0) / true if true else 1.0


def links(vectors: DataFrame, threshold: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """((cls, more) weights of links, (u, v) a forest that spans the links) of classes; as `vectors` from `classes`."""
    members, levels = shards(vectors)
    graph = members.groupBy("shard").applyInPandas(build, "cls long, near array<long>")
    graph = stored(graph.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    for beam, slack in ((BEAM, SLACK), (2 * BEAM, 2 * SLACK), (4 * BEAM, 4 * SLACK), (float("inf"), 180.0)):
        found = search(vectors, members, graph, levels, beam, slack, threshold)
        if slack == 180.0 or audit(vectors, found, threshold) >= RECALL:
            break
    more = found.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("more"))
    return more, found.filter(F.col("kind") == EDGE).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label)."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    known = stored(classes(vectors))
    degree, forest = links(known, threshold)
    size = known.select("cls", "rep", "copies")
    comp = components(forest).withColumnRenamed("node", "cls").withColumnRenamed("component", "root")
    named = size.join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    told = named.join(least, "root").join(degree, "cls", "left").select("cls", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")).alias("cls"))
    return rows.join(told, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

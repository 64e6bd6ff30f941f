"""Hard negatives by angular triangle filtering.

For each anchor the positives are the `POSITIVES` rows of its label with the greatest scores, and for each positive the
`NEGATIVES` best rows of other labels whose score lies between `LOW` and `HIGH` hundredths of the positive's. A score is the
inner product of vectors of integers, floor(`SCALE` * x); equal scores go by the smaller vec_id.

1. Every row is stored with its integers, their length and their angles to `REFERENCES` directions (rows far apart from each
   other in a sample of `SAMPLE` rows; all rows are indexed). Ordered by label, nearest direction and angle to it, rows are cut
   into windows of at most `WINDOW`; a window keeps the least and greatest angle to each direction, and length.
2. The anchors are taken in blocks of about `BLOCK_BYTES`, which travel to the tasks; all windows are read once per block.
   By the triangle inequality the angle between an anchor and a row of a window lies between the difference and the sum of
   their angles to any direction. The tightest of these give an interval of cosines and, times the lengths and widened
   for rounding, bounds of the scores. Only anchors whose wanted scores meet the bounds are scored against the window.
3. What is wanted shrinks as rows are found: below the least of the best k of a search nothing is looked for. One window
   in `FLOOR_SHARE` is searched first, and its k-th scores are where all tasks start, so tasks hand on few rows.

Scores are exact: the products run in the narrowest floating type that holds every sum of them without rounding, else in
64-bit integers. Vectors are compared with those of the same length of array only. On data without directions of its
own (a random vector in many dimensions is at a right angle to any other) the bounds exclude little and the work
is that of comparing all anchors with all rows.

Rows take no part if the label or vector is null, a component is null or not finite, or the integers are longer than
2^31 (scores would pass 64 bits). Null ids come last among ties and are no anchors. Rows that repeat an id are
rows of their own; which of several equal rows with one id comes first makes no difference. Empty tables give no
rows; zero and empty vectors have score 0 with all others. Columns other than those named are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.llm.common import stored
from repoloom.session import ensure_checkpoint_dir

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
REFERENCES, SAMPLE = 16, 1000
WINDOW, WINDOW_BYTES = 512, 2 << 20
BLOCK_BYTES = 8 << 20
FLOOR_SHARE = 16
#: Anchors scored at once, and hits held before they are cut to the best.
PANEL, HELD = 512, 1 << 18
NO_ID = 2**63 - 1
LEAST, MOST = -(2**62), 2**62

ROWS = "row long, id long, label long, dim int, q binary, norm double, angles array<double>, cell int, turn double"
WINDOWS = "label long, dim int, ids binary, rows binary, q binary, norms array<double>, least array<double>, greatest array<double>"
HITS = "search long, score long, id long, row long"


def integers(vectors: list[list[float]], dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(integers of each vector, as doubles; their lengths)."""
    q = np.floor(scale * np.array(vectors, np.float64).reshape(len(vectors), dim))
    with np.errstate(over="ignore"):
        return q, np.sqrt((q * q).sum(1))


def choose_directions(q: np.ndarray, norm: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors among the rows, each as far as can be from those before it."""
    x = q[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.zeros((0, q.shape[1]))
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(count, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def angles_to(q: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(q @ directions.T / np.maximum(norm, 1e-300)[:, None], -1, 1))


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """ROWS of the vectors (vec_id, label, embedding) that take part, numbered, stored."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))

    sample: dict[int, list] = {}
    for r in rows.select("dim", "embedding").orderBy(F.xxhash64("embedding"), F.xxhash64("id")).limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["embedding"])
    directions = {}
    for dim, some in sample.items():
        q, norm = integers(some, dim, scale)
        fits = norm < 2**31
        directions[dim] = choose_directions(q[fits], norm[fits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                q, norm = integers(part.column("embedding").to_pylist(), dim, scale)
                fits = np.flatnonzero(norm < 2**31)
                q, norm = q[fits], norm[fits]
                part = part.take(pa.array(fits))
                known = directions.get(int(dim), np.zeros((0, dim)))  # lengths that the sample lacks have no bounds
                angles = angles_to(q, norm, known)
                cell = angles.argmin(1) if angles.shape[1] else np.zeros(len(q), np.int64)
                turn = angles.min(1) if angles.shape[1] else np.zeros(len(q))
                q = q.astype("<i4")
                cols = [part.column("row"), part.column("id"), part.column("label"), part.column("dim"), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(norm, pa.float64())]
                cols += [pa.array(angles.tolist(), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(turn, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ROWS.split(", ")])

    return stored(rows.select("row", "id", "label", "dim", "embedding").mapInArrow(run, ROWS))


def windows_of(rows: DataFrame) -> DataFrame:
    """WINDOWS of neighbouring rows, each of one label and array length; stored. Hot labels are spread by the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            angles, norms = np.array([r["angles"] for r in held]), [r["norm"] for r in held]
            ids = np.array([NO_ID if r["id"] is None else r["id"] for r in held], "<i8")
            row = [held[0]["label"], held[0]["dim"], ids.tobytes(), np.array([r["row"] for r in held], "<i8").tobytes(), b"".join(r["q"] for r in held)]
            row += [[min(norms), max(norms)], angles.min(0).tolist() if angles.size else [], angles.max(0).tolist() if angles.size else []]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()] + [pa.list_(pa.float64())] * 3
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in WINDOWS.split(", ")])

        for b in batches:
            for r in b.to_pylist():
                if held and ((r["label"], r["dim"]) != (held[0]["label"], held[0]["dim"]) or len(held) == WINDOW or (len(held) + 1) * 4 * r["dim"] > WINDOW_BYTES):
                    yield flush()
                    held = []
                held.append(r)
        if held:
            yield flush()

    order = ["label", "dim", "cell", "turn", "row"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, WINDOWS))


class Anchors:
    """One block of anchors, in numpy."""

    def __init__(self, rows: list):
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.dim = np.array([r["dim"] for r in rows], np.int64)
        self.norm = np.array([r["norm"] for r in rows])
        self.q = [np.frombuffer(r["q"], "<i4") for r in rows]
        self.angles = [np.array(r["angles"]) for r in rows]
        self.groups = {}
        for dim in np.unique(self.dim):
            at = np.flatnonzero(self.dim == dim)
            self.groups[int(dim)] = (at, np.array([self.q[i] for i in at]).reshape(len(at), dim), np.array([self.angles[i] for i in at]).reshape(len(at), -1))


def score_bounds(angles: np.ndarray, norm: np.ndarray, norms: list[float], least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor with the rows of a window, never too tight."""
    near, far = np.zeros(len(angles)), np.full(len(angles), np.pi)
    if angles.shape[1]:
        near = np.maximum(near, np.maximum(least - angles, angles - greatest).max(1) - 1e-7)
        far = np.minimum(far, np.minimum(angles + greatest, 2 * np.pi - angles - least).min(1) + 1e-7)
    low, high = np.cos(np.minimum(np.maximum(far, 0), np.pi)), np.cos(np.clip(near, 0, np.pi))
    spread = np.array(norms)
    low, high = (norm[:, None] * low[:, None] * spread).min(1), (norm[:, None] * high[:, None] * spread).max(1)
    slack = 1 + 1e-9 * norm * spread.max()
    return np.floor(low - slack), np.ceil(high + slack)


def exact_scores(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Inner products as integers; every partial sum is at most `longest`, so the narrowest type that holds it is exact."""
    if longest < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if longest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best `k` hits of each search. A search belongs to an anchor and wants scores in low..high."""

    def __init__(self, n_anchors: int, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.least = np.maximum(low, floor)
        order = np.argsort(anchor, kind="stable")
        self.searches = order
        self.count = np.bincount(anchor, minlength=n_anchors)
        self.first = np.cumsum(self.count) - self.count
        self.n_anchors, self.held, self.size = n_anchors, [], 0
        self._wanted()

    def _wanted(self) -> None:
        """Per anchor the least and greatest score that any of its searches wants."""
        self.need, self.cap = np.full(self.n_anchors, MOST), np.full(self.n_anchors, LEAST)
        open_ = self.least <= self.high
        np.minimum.at(self.need, self.anchor[open_], self.least[open_])
        np.maximum.at(self.cap, self.anchor[open_], self.high[open_])

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        n = self.count[anchor]
        at = np.repeat(np.arange(len(anchor)), n)
        search = self.searches[np.repeat(self.first[anchor] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        fits = (score[at] >= self.least[search]) & (score[at] <= self.high[search])
        at, search = at[fits], search[fits]
        self.held.append(np.stack([search, score[at], ids[at], rows[at]]))
        self.size += len(at)
        if self.size > HELD:
            self.cut()

    def cut(self) -> np.ndarray:
        """(search, score, id, row) of the best hits so far, after dropping the others."""
        all_ = np.concatenate(self.held, axis=1) if self.held else np.zeros((4, 0), np.int64)
        all_ = all_[:, np.lexsort((all_[3], all_[2], -all_[1], all_[0]))]
        place = np.arange(all_.shape[1]) - np.searchsorted(all_[0], all_[0])
        last = place == self.k - 1
        self.least[all_[0][last]] = np.maximum(self.least[all_[0][last]], all_[1][last])
        all_ = all_[:, place < self.k]
        self.held, self.size = [all_], 0
        self._wanted()
        return all_


def search(windows: DataFrame, anchors: Anchors, own: bool, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """HITS: the best k of each task's windows per search, in rows of the anchor's label (`own`) or of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row), anchor, low.copy(), high, floor, k)
        for b in batches:
            for w in b.to_pylist():
                if w["dim"] not in anchors.groups:
                    continue
                at, q, angles = anchors.groups[w["dim"]]
                take = np.flatnonzero((anchors.label[at] == w["label"]) == own)
                lowest, highest = score_bounds(angles[take], anchors.norm[at[take]], w["norms"], np.array(w["least"]), np.array(w["greatest"]))
                take = take[(highest >= best.need[at[take]]) & (lowest <= best.cap[at[take]])]
                ids, rows = np.frombuffer(w["ids"], "<i8"), np.frombuffer(w["rows"], "<i8")
                x = np.frombuffer(w["q"], "<i4").reshape(len(ids), w["dim"])
                for i in range(0, len(take), PANEL):
                    part = take[i : i + PANEL]
                    who = at[part]
                    s = exact_scores(q[part], x, float(anchors.norm[who].max()) * max(w["norms"]) * 1.001 + 1)
                    r, c = np.nonzero((s >= best.need[who][:, None]) & (s <= best.cap[who][:, None]))
                    if own:
                        other = anchors.row[who[r]] != rows[c]
                        r, c = r[other], c[other]
                    best.add(who[r], s[r, c], ids[c], rows[c])
        got = best.cut()
        for i in range(0, got.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in got[:, i : i + (1 << 16)]], [c.split()[0] for c in HITS.split(", ")])

    return windows.mapInArrow(run, HITS)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def floors(windows: DataFrame, anchors: Anchors, own: bool, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """For each search the k-th score in a share of the windows: scores below it are not among the best k of all."""
    some = windows.filter(F.pmod(F.xxhash64("rows"), F.lit(FLOOR_SHARE)) == 0)
    floor = np.full(len(anchor), LEAST)
    hits = search(some, anchors, own, anchor, low, high, floor, k)
    for r in best_of(hits, k).filter(F.col("rank") == k).select("search", "score").collect():  # a number per search of the block
        floor[r["search"]] = r["score"]
    return floor


def mine(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the vectors (vec_id, label, embedding).

    `is_anchor` is a condition on the column `id`, the vec_id."""
    spark = vectors.sparkSession
    rows = prepared(vectors, scale)
    windows = windows_of(rows)
    asked = rows.filter(F.col("id").isNotNull() & is_anchor)
    size = asked.agg(F.sum(F.length("q") + 8 * F.size("angles") + 100)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // BLOCK_BYTES))
    home = f"{ensure_checkpoint_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = []
    for block in range(n_blocks):
        mine_ = asked.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block).drop("cell", "turn").orderBy("row").collect()
        if not mine_:
            continue
        anchors = Anchors(mine_)
        n = len(mine_)
        each, anything = np.arange(n), (np.full(n, LEAST), np.full(n, MOST))
        floor = floors(windows, anchors, True, each, *anything, positives)
        found = best_of(search(windows, anchors, True, each, *anything, floor, positives), positives).collect()  # `positives` a row of the block
        found = sorted(((r["search"], r["rank"], r["score"], r["id"]) for r in found))
        anchor = np.array([f[0] for f in found], np.int64)
        lowest, highest = np.array([-(-low * f[2] // 100) for f in found], np.int64), np.array([high * f[2] // 100 for f in found], np.int64)
        floor = floors(windows, anchors, False, anchor, lowest, highest, negatives)
        hits = search(windows, anchors, False, anchor, lowest, highest, floor, negatives)
        pairs = [(i, mine_[f[0]]["id"], None if f[3] == NO_ID else f[3], f[2]) for i, f in enumerate(found)]
        named = spark.createDataFrame(pairs, "search long, anchor_id long, positive_id long, positive_score long")
        told = best_of(hits, negatives).join(F.broadcast(named), "search")  # bounded by the block
        told = told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made.append(f"{home}/{block}")
        told.write.parquet(made[-1])
    return spark.read.schema(schema).parquet(*made) if made else spark.createDataFrame([], schema)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.common import stored


def union_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for the edges given, roots left out."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:  # roots of roots
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v, root = union_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], ["u", "v"])


def _shape(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u long, v long); component is the smallest node.

    Each batch of edges is first reduced to stars by union-find, so groups of copies cost
    one edge a member. Then large-star and small-star steps run until the edges stay the
    same; every step is a grouped minimum (combined on the map side) and a join back, whose
    right side is unique. Edges with a null end and loops are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null and u <> v")
    now = stored(edges.mapInArrow(_contract, "u long, v long"))
    shape = _shape(now)
    while shape[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: edges point down now, from u to smaller v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = stored(small.select("e.*").filter("u <> v").distinct())
        seen = _shape(new)
        now = new
        if seen == shape:
            break
        shape = seen
    low = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return low.select(F.col("u").alias("node"), "component").union(roots)

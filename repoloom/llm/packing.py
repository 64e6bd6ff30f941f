"""Packing by concatenation: documents' ids stand one after another and are cut every `window` ids.

Two passes. The first encodes, and counts ids before each document within its partition;
its rows are stored. The totals of the partitions, one number each, give every partition
its global offset (prefix sums on the driver, as many as there are partitions). The second
pass is then local to each row: a document at global place g is cut at the multiples of
the window, and each piece is a boundary record. Nothing is shuffled, and only the very
last sequence can be short.

Null and empty texts are the end id alone. Repeated rows are packed as often as they stand.
A null doc_id stays null. The order is that of the input's partitions. Texts of any length are encoded whole, other
columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.common import blocks, stored
from repoloom.llm.subword import Subwords

WINDOW = 1024


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, before, doc_id, n_ids, ids): `ids` as little-endian numbers of the narrowest width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, part, before = Subwords.of(tokenizer), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2") if max(sub.vocab_size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for b in blocks(batches, "text", 2 << 20):
            ids = [np.append(x, end_id).astype(kind) for x in sub.encode(b.column("text").to_pylist())]
            n = np.array([len(x) for x in ids])
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            cols = [pa.array(np.full(len(ids), part)), pa.array(start), b.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "before", "doc_id", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part long, before long, doc_id long, n_ids long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids binary])."""
    rows = stored(encoded(docs, tokenizer, end_id))
    totals = dict(rows.groupBy("part").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "ids"):
            out: list[list] = [[] for _ in names]
            parts, before, doc, n, ids = (c.to_pylist() for c in b.columns)
            for i in range(len(doc)):
                width = len(ids[i]) // n[i]
                all_ids = np.frombuffer(ids[i], f"<u{width}").astype("<u4")
                at = base[parts[i]] + before[i]
                edge = [at, *range((at // window + 1) * window, at + n[i], window), at + n[i]]
                for a, z in zip(edge[:-1], edge[1:]):
                    piece = all_ids[a - at : z - at].tobytes()
                    for col, x in zip(out, (doc[i], a - at, z - a, zlib.crc32(piece), n[i], a // window, a % window, piece)):
                        col.append(x)
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(cut, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False)

"""What several operators share: stored tables, row keys and blocks of Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared checkpoint folder: computed once, safe from lost executors."""
    spark, path = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(_id, _th): names a document by id and content; null ids and null texts have keys too."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.col(text), F.col(text).isNull()).alias("_th"),
    ]


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `max_bytes`; a row is never split."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            held += int(sizes[i])
            if held >= max_bytes:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < n:
            yield batch.slice(start)

"""Token files: concatenated ids with document boundaries in Elias-Fano code.

Documents are range-partitioned by id, sorted, encoded, and written in blocks of about
`block_ids` ids (whole documents; a larger document has a block of its own). A block is a
row of a Parquet table: `ids` little-endian numbers, `doc_ids` in order, and the ends of the
documents as an Elias-Fano sequence. Such a sequence of n numbers below u keeps the lowest
l = floor(log2(u / n)) bits of each number side by side (`low`) and the rest in unary (`high`: bit
(x >> l) + i is set for the i-th number x), about 2 + l bits a document. `select` finds the
i-th set bit of `high` by population counts sampled every 64 bits, so an offset is read
without a table of 64-bit numbers.

Blocks know their partition and the ids before them in it; the totals of the partitions (one
number each, summed on the driver) make that global.

Null ids sort first and stay null; null texts are empty, and every document has at least the end
id. Rows that repeat an id are ordered by text and kept. An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks
from repoloom.llm.subword import Subwords
from repoloom.session import ensure_checkpoint_dir

BLOCK_IDS = 1 << 20
BLOCK_SCHEMA = "part long, block long, before long, n_docs long, n_ids long, low_bits int, low binary, high binary, doc_ids array<long>, ids binary"


def ef_encode(values: np.ndarray, bound: int) -> tuple[int, bytes, bytes]:
    """(low_bits, low, high) of sorted values in 0..bound."""
    n = len(values)
    low_bits = max(0, int(bound // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    high = np.zeros(n + (bound >> low_bits) + 1, np.uint8)
    high[(v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return low_bits, pack(low), pack(high)


class EliasFano:
    """Read access by position to a sequence made by `ef_encode`."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.words = np.frombuffer(high + bytes(-len(high) % 8), "<u8")
        self.rank = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)  # set bits up to each word

    def select(self, i: np.ndarray) -> np.ndarray:
        """Positions of the i-th set bits."""
        word = np.searchsorted(self.rank, i, side="right")
        left = i - np.where(word > 0, self.rank[word - 1], 0)
        w, at = self.words[word], np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # halve the word: skip the lower part if the bit is above it
            part = np.bitwise_count(w & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= part
            left = np.where(up, left - part, left)
            at += np.where(up, step, 0)
            w = np.where(up, w >> np.uint64(step), w)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self.select(i) - i
        low = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            bit = i * self.low_bits + b
            low |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return (high << self.low_bits) | low


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, part, block, before = Subwords.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        kind = np.dtype("<u2") if max(sub.vocab_size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            row = [part, block, before, len(held), size, *ef_encode(ends, size), names, np.concatenate(held).tobytes()]
            types = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            cols = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], cols)

        for b in blocks(batches, "text", 2 << 20):
            for name, ids in zip(b.column("doc_id").to_pylist(), sub.encode(b.column("text").to_pylist())):
                ids = np.append(ids, end_id).astype(kind)
                if held and size + len(ids) > block_ids:
                    yield flush()
                    names, held, block, before, size = [], [], block + 1, before + size, 0
                names.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary, 32-bit]) per document, from the files alone."""
    table = spark.read.parquet(path)
    totals = dict(table.groupBy("part").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "ids"):
            for r in b.to_pylist():
                ends = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"]).get(np.arange(r["n_docs"]))
                starts = np.r_[0, ends[:-1]]
                ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['n_ids']}")
                texts = [ids[s:e].astype("<u4").tobytes() for s, e in zip(starts, ends)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(base[r["part"]] + r["before"] + starts), pa.array(ends - starts), pa.array([zlib.crc32(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return table.select([x.split()[0] for x in BLOCK_SCHEMA.split(", ")]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path, with_ids=False)

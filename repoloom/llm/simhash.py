"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's words are runs without ASCII white space, A-Z lower-cased; its shingles are
`shingle` consecutive words joined by spaces, repeats included (all words if there are
fewer, none for a text without words). Every shingle votes with its XXH64 (seed 42) on 64
bits, and a bit is set if it is set in more than half of the votes.

Linking: prints at distance at most `max_bits` meet in the middle, because both emit every
variant within half the radius. An odd radius has no middle, so the prints are punctured:
the 64 bits are cut into four blocks and each copy leaves one block out. A pair at
distance 3 has a differing bit in some block, and without that block it is at distance 2
at most, where the 1-bit balls of both sides share a variant. An even radius needs no cut.
Variants are shuffled, and the prints that meet on one are verified by their exact
distance. Prints are made distinct first, so copies cost nothing.

Null and empty texts have the print 0 and are linked like any other. Documents of equal id
are judged by their own texts; a null id takes part but never names a component. Texts of any length are
taken whole, other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.common import blocks, stored, text_key
from repoloom.llm.components import components, union_roots

SHINGLE, MAX_BITS = 3, 3
SEED = 42
#: Votes are counted in pieces of so many shingles, so a long text costs no more memory.
PIECE = 1 << 16
#: Distances inside a bucket are taken in squares of this side.
SIDE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    votes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(votes), PIECE):
        ones += np.unpackbits(votes[i : i + PIECE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(votes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, with_hash: bool = False) -> DataFrame:
    """(doc_id, fp[, _th]) per document; fp is the print as a signed long, _th the hash of the text."""
    names = ["doc_id", "_th"] if with_hash else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), *(b.column(n) for n in names)], ["fp", *names])

    rows = docs.select(F.col("doc_id").cast("long"), text_key()[1], "text")
    return rows.select(*names, "text").mapInArrow(run, "fp long, " + ", ".join(f"{n} long" for n in names))


def masks(max_bits: int) -> tuple[list[np.uint64], list[list[np.uint64]]]:
    """For each puncture: the bits kept, and the flips within half the radius."""
    half = max_bits // 2
    cuts = [range(0)] if max_bits % 2 == 0 else [range(i, i + 16) for i in range(0, 64, 16)]
    keep, flips = [], []
    for cut in cuts:
        kept = [i for i in range(64) if i not in cut]
        keep.append(np.uint64(sum(1 << i for i in kept)))
        flips.append([np.uint64(sum(1 << i for i in c)) for n in range(half + 1) for c in combinations(kept, n)])
    return keep, flips


def _variants(max_bits: int):
    keep, flips = masks(max_bits)
    cut, flip = np.repeat(np.arange(len(keep)), [len(f) for f in flips]), np.array([x for f in flips for x in f])
    kept = np.array(keep)[cut]
    # the left-out block of a punctured variant is free to hold which block it is
    tag = np.array([np.uint64(0) if len(keep) == 1 else np.uint64((c + 1) << (16 * int(c))) for c in cut])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                keys = (((part[:, None] & kept) ^ flip) | tag).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(flip)).view(np.int64))], ["key", "fp"])

    return run


def bucket_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between the prints of one bucket."""
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for i in range(0, len(fps), SIDE):
        for j in range(i, len(fps), SIDE):
            x, y = np.nonzero(np.bitwise_count(fps[i : i + SIDE, None] ^ fps[None, j : j + SIDE]) <= max_bits)
            ok = (x + i) < (y + j)
            v, root = union_roots(np.concatenate([a, fps[i + x[ok]]]), np.concatenate([b, fps[j + y[ok]]]))
            a, b = v, root
    return a, b


def _verify(max_bits: int):
    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Links of whole runs of equal keys, pairs at once and larger runs one by one."""
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[start, len(keys)])
        two = start[n == 2]
        ok = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits
        us, vs = [fps[two][ok]], [fps[two + 1][ok]]
        for s, m in zip(start[n > 2], n[n > 2]):
            a, b = bucket_links(fps[s : s + m], max_bits)
            us.append(a)
            vs.append(b)
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # sorted by key; the last run waits for the next batch
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield links(keys, fps)

    return run


def print_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links that connect all distinct prints of `prints` (fp long) within `max_bits`."""
    variants = prints.mapInArrow(_variants(max_bits), "key long, fp long")
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(max_bits), "u long, v long").distinct()


def roots(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for each print of `prints` (fp, once each): the smallest print reachable by links."""
    comp = components(print_links(prints, max_bits))
    return prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs (doc_id, text): the smallest id reachable by links."""
    fps = stored(fingerprints(docs, shingle))
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = reps.join(roots(reps.select("fp"), max_bits), "fp")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs` for each group, all columns kept: that of the smallest id (null last), then hash of the text.

    Rows of one id with different texts are judged apart; of rows that repeat an id and a text one stays.
    """
    fps = fingerprints(docs, shingle, with_hash=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("first")
    reps = stored(fps.groupBy("fp").agg(first))
    kept = reps.join(roots(reps.select("fp"), max_bits), "fp").groupBy("root").agg(F.min("first").alias("first"))
    name, text = text_key()
    kept = kept.select("first.doc_id", "first._th").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "_th")
    rows = docs.select(F.struct("*").alias("_row"), name, text)  # columns of docs may have any name
    return rows.join(kept, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

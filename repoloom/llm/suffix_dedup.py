"""Exact substring removal by suffix arrays per shard and merging across shards.

A byte goes if it lies in a string of `min_bytes` bytes (a window) that starts anywhere else too.

1. Anchors. In every window the `GRAM`-byte string of the smallest hash is its anchor; equal windows
   have equal anchors, about one byte in 70 is one. Anchors whose hash occurs once in the
   corpus can't lie in a repeated window, so only documents with others go on.
2. Shards. Each task concatenates the surroundings of repeated anchors to shards of
   `SHARD_BYTES`, sorts their suffixes by Larsson and Sadakane's refinement (groups of equal
   prefixes, twice as long in each round, sorted ones left alone), and takes common prefixes of
   neighbours by Kasai's rule, many stretches of the text side by side. Prefixes of
   `min_bytes` or more are repeated windows.
3. Across shards. A shard sends the surroundings of each anchor that other shards may hold,
   each different text once. Those of one anchor meet in one task, where the hashes of their
   windows are sorted and found by binary search. Anchors that occur more than `HOT` times send
   a digest for each window instead, which is counted as an ordinary group.
4. The repeated windows of a document become spans, and the document is cut.

Texts are UTF-8 bytes; null is empty. Rows are known by (doc_id, hash of the text), so rows of one
id are judged apart unless their texts are equal too; then each repeats the other, and one row of them stands for all
in steps 1 to 3.
Texts below `min_bytes` keep everything. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks, stored, text_key

MIN_BYTES = 200
GRAM = 64
SHARD_BYTES = 3 << 20
PIECE_BYTES = 2 << 20
HOT = 200_000
#: Contexts of whole anchors are merged so many at a time, or one anchor's.
MERGE_ROWS = 10_000

_RANDOM = np.random.default_rng(8).integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    w = 1
    n = len(x) - width + 1
    while w * 2 <= width:
        x = least(x[:-w], x[w:])
        w *= 2
    return least(x[:n], x[width - w : width - w + n])


def anchors(texts: list[bytes], min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors of texts that are laid side by side."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(b), min_bytes - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < min_bytes:
        return none, none, none
    sums = np.r_[_U(0), np.cumsum(_RANDOM[b] * _powers(pow(_BASE, -1, 1 << 64), n))]
    g = (sums[GRAM:] - sums[:-GRAM]) * _powers(_BASE, n - GRAM + 1)
    g ^= g >> _U(32)
    g *= _U(0xD6E8FEB86659FD93)
    g ^= g >> _U(29)
    least = _sliding(g, width, np.minimum)
    ok = np.zeros(n + 1, np.int32)
    long = size >= min_bytes
    ok[(end - size)[long]] += 1
    ok[(end - min_bytes + 1)[long]] -= 1
    least[np.cumsum(ok)[: len(least)] == 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == g) & (g != 0))
    text = np.searchsorted(end, at, side="right")
    return text, at - (end - size)[text], g[at].view(np.int64)


def suffix_array(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, the 8 bytes at each place as a number). Places are 32 bits wide: a shard has a few million."""
    n = len(b)
    padded = np.r_[b, np.zeros(16, np.uint8)]
    word = np.zeros(n + 8, np.uint64)
    for j in range(8):
        word <<= _U(8)
        word |= padded[j : j + n + 8]
    order = np.argsort(word[:n]).astype(np.int32)
    held = word[order]
    head = np.r_[True, held[1:] != held[:-1]]
    del held
    group = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))  # of each place in the order: where its group begins
    rank = np.empty(n, np.int32)
    rank[order] = group
    h = 8
    while True:
        many = np.r_[group[1:] == group[:-1], False]
        many[1:] |= many[:-1]
        u = np.flatnonzero(many).astype(np.int32)
        if not len(u):
            break
        s = order[u]
        key = group[u].astype(np.int64) * (n + 1)
        key += np.where(s < n - h, rank[np.minimum(s, n - 1 - h) + h] + 1, 0)
        by = np.argsort(key)
        key = key[by]
        order[u] = s[by]
        del by, s
        group[u] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], u, np.int32(0)))
        del key
        rank[order[u]] = group[u]
        h *= 2
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, most: int, lanes: int = 1 << 15) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to `most`."""
    n = len(order)
    where, before = np.empty(n, np.int32), np.empty(n, np.int32)
    where[order] = np.arange(n, dtype=np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out = np.zeros(n, np.int32)
    steps = -(-n // lanes)
    base, h = np.arange(min(lanes, n)) * steps, np.zeros(min(lanes, n), np.int64)
    for step in range(steps):
        i = base + step
        inside = i < n
        j = before[np.minimum(i, n - 1)]
        go = np.flatnonzero(inside & (j >= 0))
        h[~inside | (j < 0)] = 0
        while len(go):
            x = word[np.minimum(i[go] + h[go], n)] ^ word[np.minimum(j[go] + h[go], n)]
            # equal leading bytes by the exponent of x as a double; clearing the bit below the top one keeps it from rounding up
            x &= ~(x >> _U(1))
            same = np.minimum((63 + 1023 - (x.astype(np.float64).view(np.int64) >> 52)) >> 3, 8)
            h[go] += same
            go = go[(same == 8) & (h[go] < most)]
        out[where[i[inside]]] = np.minimum(h[inside], most)
        h = np.maximum(h - 1, 0)  # the next place shares all but one byte of it (Kasai)
    return out


def repeated_in_shard(pieces: list[bytes], min_bytes: int) -> list[np.ndarray]:
    """For each piece, where windows start that start elsewhere in the shard too."""
    # 255 is in no UTF-8 text, and the number after it is the piece's own; the last byte tells suffixes of zeros apart
    b = np.frombuffer(b"".join(p + b"\xff" + i.to_bytes(7, "big") for i, p in enumerate(pieces)) + b"\xfe", np.uint8)
    size = np.array([len(p) for p in pieces])
    order, word = suffix_array(b)
    again = common_prefixes(order, word, min_bytes) >= min_bytes
    hit = np.zeros(len(b), bool)
    hit[order[again]] = True
    hit[order[np.flatnonzero(again) - 1]] = True
    begin = np.cumsum(size + 8) - size - 8
    return [np.flatnonzero(hit[s : s + max(0, n - min_bytes + 1)]) for s, n in zip(begin, size)]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows of `length` at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


SENT = "_id long, _th long, h long, start long, stop long, context int, bytes binary"
_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


def _shards(min_bytes: int, hot: int):
    """Documents with their repeated anchors to rows of SENT: spans (context 0), contexts (1) and window digests (2)."""
    left, right = min_bytes - GRAM, min_bytes

    def shard(docs: list[tuple]) -> pa.RecordBatch:
        pieces, owner = [], []
        for d, (_, _, text, pos, _, _) in enumerate(docs):
            low, high = np.maximum(pos - left, 0), np.minimum(pos + right, len(text))
            cut = np.flatnonzero(low[1:] > high[:-1])
            for a, z in zip(low[np.r_[0, cut + 1]].tolist(), high[np.r_[cut, len(pos) - 1]].tolist()):
                if z - a >= min_bytes:
                    pieces.append(text[a:z])
                    owner.append((d, a))
        rows: list[tuple] = []
        if pieces:
            starts: list[list[np.ndarray]] = [[] for _ in docs]
            for (d, a), s in zip(owner, repeated_in_shard(pieces, min_bytes)):
                starts[d].append(s + a)
            for (i, th, *_), s in zip(docs, starts):
                rows += [(i, th, None, a, z, 0, None) for a, z in runs(np.sort(np.concatenate(s)) if s else np.zeros(0, np.int64), min_bytes)]
        own = dict(zip(*(x.tolist() for x in np.unique(np.concatenate([d[4] for d in docs]), return_counts=True))))
        sent: set[bytes] = set()
        for i, th, text, pos, hashes, counts in docs:
            for p, h, n in zip(pos.tolist(), hashes.tolist(), counts.tolist()):
                if own[h] == n:  # no other shard has it
                    continue
                low, high = max(0, p - left), min(len(text), p + right)
                if n <= hot:
                    piece = text[low:high]
                    if high - low >= min_bytes and (name := xxhash.xxh3_128_digest(piece + (p - low).to_bytes(4, "big"))) not in sent:
                        sent.add(name)
                        rows.append((i, th, h, low, p - low, 1, piece))
                else:
                    for s in range(low, high - min_bytes + 1):
                        if (name := xxhash.xxh3_128_digest(text[s : s + min_bytes])) not in sent:
                            sent.add(name)
                            rows.append((i, th, None, s, s + min_bytes, 2, name))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in blocks(batches, "text", 1 << 20):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for i, th, text, marks in zip(b.column("_id").to_pylist(), b.column("_th").to_pylist(), texts, b.column("marks").to_pylist()):
                marks = sorted((m["pos"], m["h"], m["n"]) for m in marks)
                pos, h, n = (np.array(x, np.int64) for x in zip(*marks))
                # a long document is spread over shards; a window lies in the part of its anchor
                part = pos // PIECE_BYTES
                for k in np.unique(part):
                    at = part == k
                    if held and size + len(text) > SHARD_BYTES:
                        yield shard(held)
                        held, size = [], 0
                    held.append((i, th, text, pos[at], h[at], n[at]))
                    size += min(len(text), PIECE_BYTES)
        if held:
            yield shard(held)

    return run


def _merge(min_bytes: int):
    """Contexts sorted by anchor to (_id, _th, start, stop) of windows that two contexts of an anchor share."""
    left, span = min_bytes - GRAM, 2 * min_bytes - GRAM

    def shared(ids, ths, hs, lows, lefts, texts) -> pa.RecordBatch:
        n = len(texts)
        size = np.array([len(t) for t in texts])
        off = left - lefts  # anchors stand in one column
        m = np.zeros((n, span), np.uint8)
        m[np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - off, size)] = np.frombuffer(b"".join(texts), np.uint8)
        values = np.ascontiguousarray(m.T)
        mark = hs.view(np.uint64) * _U(0xBF58476D1CE4E5B9)
        rolling = np.zeros(n, np.uint64)
        for j in range(min_bytes - 1):
            rolling = rolling * _U(_BASE) + _RANDOM[values[j]]
        drop = _U(pow(_BASE, min_bytes, 1 << 64))
        hit = np.zeros((left + 1, n), bool)
        for o in range(left + 1):
            rolling = rolling * _U(_BASE) + _RANDOM[values[o + min_bytes - 1]]
            if o:
                rolling -= drop * _RANDOM[values[o - 1]]
            ok = np.flatnonzero((off <= o) & (off + size >= o + min_bytes))
            if len(ok) > 1:
                mine = rolling[ok] ^ mark[ok]
                mine ^= mine >> _U(31)
                by = np.argsort(mine)
                ordered = mine[by]  # searched in its own order, which stays in the cache
                many = np.searchsorted(ordered, ordered, "right") - np.searchsorted(ordered, ordered) > 1
                hit[o, ok[by[many]]] = True
        # the windows of a context all hold its anchor, so they make one run
        i = np.flatnonzero(hit.any(0))
        low = lows[i] - off[i]
        first, last = hit[:, i].argmax(0), left - hit[::-1, i].argmax(0)
        cols = [ids[i], ths[i], low + first, low + last + min_bytes]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "_th", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            hs = t.column("h").to_numpy()
            cut = len(hs) if last else int(np.searchsorted(hs, hs[-1]))
            if cut:
                part = t.slice(0, cut)
                yield shared(*(part.column(c).to_numpy() for c in ("_id", "_th", "h", "start", "stop")), part.column("bytes").to_pylist())
            held, rows = ([] if last else t.slice(cut).to_batches()), len(hs) - cut

        for b in batches:
            for i in range(0, b.num_rows, MERGE_ROWS):
                held.append(b.slice(i, MERGE_ROWS))
                rows += held[-1].num_rows
                if rows >= MERGE_ROWS:
                    yield from flush(False)
        if rows:
            yield from flush(True)

    return run


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((_id, _th, spans array<struct<start, stop>>), (_id, _th, text)): repeated bytes, and the documents that may have some.

    `docs` (_id, _th, text) has each key once."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2 << 20):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            if len(texts[-1]) <= PIECE_BYTES:
                t, pos, h = anchors(texts, min_bytes)
                parts = [(t, pos, h)]
            else:  # the last text of a block may be long; its windows are dealt to pieces
                parts = [anchors(texts[:-1], min_bytes)]
                for s in range(0, len(texts[-1]), PIECE_BYTES):
                    t, pos, h = anchors([texts[-1][s : s + PIECE_BYTES + min_bytes - 1]], min_bytes)
                    parts.append((t + len(texts) - 1, pos + s, h))
            t, pos, h = (np.concatenate(x) for x in zip(*parts))
            _, once = np.unique(np.stack([t, pos]), axis=1, return_index=True) if len(parts) > 1 else (None, np.arange(len(t)))
            take = pa.array(t[once])
            yield pa.RecordBatch.from_arrays([b.column("_id").take(take), b.column("_th").take(take), pa.array(h[once]), pa.array(pos[once])], ["_id", "_th", "h", "pos"])

    keyed = docs.select("_id", "_th", "text")
    marks = stored(keyed.filter(F.octet_length("text") >= min_bytes).mapInArrow(mark, "_id long, _th long, h long, pos long"))
    # stored, so that the join reads two plain exchanges and AQE can split an anchor of many documents
    again = stored(marks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    found = marks.join(again, "h").groupBy("_id", "_th").agg(F.collect_list(F.struct("pos", "h", "n")).alias("marks"))  # a document's own
    likely = stored(keyed.join(found, ["_id", "_th"]))
    sent = stored(likely.select("_id", "_th", "text", "marks").mapInArrow(_shards(min_bytes, hot), SENT))
    spans = sent.filter("context = 0").select("_id", "_th", "start", "stop")
    merged = sent.filter("context = 1").repartition("h").sortWithinPartitions("h").mapInArrow(_merge(min_bytes), "_id long, _th long, start long, stop long")
    many = sent.filter("context = 2")
    twice = many.groupBy("bytes").count().filter("count > 1").select("bytes")
    spans = spans.union(merged).union(many.join(twice, "bytes", "left_semi").select("_id", "_th", "start", "stop"))
    spans = spans.distinct().groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return spans, likely.select("_id", "_th", "text")


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The bytes outside of sorted spans, and the number of maximal runs removed."""
    kept, at, n = [], 0, 0
    stop = -1
    for s in spans:
        if s["start"] > stop:
            n += 1
            kept.append(text[at : s["start"]])
        stop = max(stop, s["stop"])
        at = stop
    return b"".join([*kept, text[at:]]), n


def one_row_each(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_id, _th, text) with each key once, (_id, _th) of those that several rows share).

    Rows that share a key are reduced on the map side; the others pass without a shuffle where those keys are few."""
    keyed = docs.select(*text_key(), "text")
    shared = stored(keyed.groupBy("_id", "_th").count().filter("count > 1").select("_id", "_th"))
    one = keyed.join(shared, ["_id", "_th"], "left_semi").groupBy("_id", "_th").agg(F.first("text").alias("text"))
    return keyed.join(shared, ["_id", "_th"], "left_anti").unionByName(one), shared


def removed(docs: DataFrame, min_bytes: int = MIN_BYTES, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(_id, _th, n_removed, n_spans, kept_sha256[, kept string]) of documents that lose bytes.

    `kept` is decoded where the text is cut: a second pass through Python in the same task would be a second worker for every core.
    """
    each, shared = one_row_each(docs)
    spans, likely = repeated_spans(each, min_bytes, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            kept = [_cut(t, s) for t, s in zip(texts, b.column("spans").to_pylist())]
            cols = [b.column("_id"), b.column("_th"), pa.array([len(t) - len(k) for t, (k, _) in zip(texts, kept)], pa.int64()), pa.array([n for _, n in kept], pa.int64())]
            cols.append(pa.array([hashlib.sha256(k).hexdigest() for k, _ in kept], pa.string()))
            if with_text:
                cols.append(pa.array([k.decode("utf-8", "ignore") for k, _ in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["_id", "_th", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    schema = "_id long, _th long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    cut = likely.join(spans.join(shared, ["_id", "_th"], "left_anti"), ["_id", "_th"]).mapInArrow(run, schema)
    # every string of a text that two rows share starts in the other one too
    nothing = [F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept")]
    gone = docs.select(*text_key(), F.octet_length("text").cast("long").alias("n_removed")).filter(F.col("n_removed") >= min_bytes)
    gone = gone.join(shared, ["_id", "_th"], "left_semi").distinct().select("_id", "_th", "n_removed", *nothing[: 2 + with_text])
    return cut.unionByName(gone)


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`docs` with the repeated bytes cut out of text (and n_chars, if there, counted anew); all rows and columns stay.

    A character that is cut in two loses its other bytes as well.
    """
    cut = removed(docs, min_bytes, with_text=True).select("_id", "_th", F.col("kept").alias("_kept"))
    rows = docs.select(F.struct("*").alias("_row"), *text_key()).join(cut, ["_id", "_th"], "left")  # columns of docs may have any name
    kept = {"text": F.coalesce("_kept", "_row.text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col("_kept").isNotNull(), F.char_length("_kept")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(kept.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *text_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    return rows.join(removed(docs), ["_id", "_th"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )

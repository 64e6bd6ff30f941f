"""Benchmark decontamination: CGK embedding, coordinate sampling and exact edit distances.

Texts and items are words (runs of letters and digits, lower-cased). A text is contaminated by an
item of n words if a passage is within floor(n * (1 - `SIMILARITY`)) word edits of it. Around every
word starts an item-sized window. An edit spoils one word and two pairs of neighbours at most, so a
window with fewer than n - k words of any item, or n - 2 - 2k word pairs of items of n words,
can't be within k edits; it is left out, which loses nothing (a pair that repeats itself at once counts as
one, if it does so in no item). The CGK random walk
maps a window to 2n words: step j writes the word under the cursor and moves on or stays by a coin, a
hash of (walk, j, word), so that windows at small edit distance agree in most coordinates (what comes after 2n
steps is rarely reached by differing text). Hashes of `SAMPLE` random coordinates, `TABLES` times for each of `WALKS` walks, find
candidates; tests measure that they reach 0.95 of the passages at the largest distance. Each
candidate's edit distance is then computed exactly, with its end free, inside the band that its bound leaves.

Items are taken in blocks of about `ITEM_BYTES`, so what travels to the tasks is bounded; windows are hashed
`WINDOW_WORDS` words at a time, so memory follows the longest item and the block, not items times vocabulary.

Items of fewer than 5 words allow no edit; items and texts that are null or have no words match
nothing. Items of equal words are found together, and of equal places the first counts. Repeated rows are judged each; null ids
are kept. An empty table of texts or items gives no rows. Only doc_id, item_id and text are read, so columns may
clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks

SIMILARITY = 0.8
WALKS, TABLES, SAMPLE = 8, 8, 4
ITEM_BYTES = 8 << 20
#: Words of windows that are walked over at once.
WINDOW_WORDS = 1 << 21
#: Size of the table of word pairs, far above the pairs of one block.
PAIR_SLOTS = 1 << 22
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def end_free_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, length): the least distance of the item to a beginning of the text, most + 1 if above; the shortest such."""
    far = most + 1
    row = np.minimum(np.arange(len(text) + 1), far)
    for i, w in enumerate(item, 1):
        a, b = max(1, i - most), min(len(text), i + most)  # more than `most` off the diagonal costs more than `most`
        new = np.full(len(row), far)
        if a == 1:
            new[0] = min(i, far)
        if a <= b:
            steps = np.arange(a - 1, b + 1)
            up = np.minimum(row[a : b + 1] + 1, row[a - 1 : b] + (text[a - 1 : b] != w))
            new[a - 1 : b + 1] = np.minimum(np.minimum.accumulate(np.r_[new[a - 1], up] - steps) + steps, far)  # letters put in between
        row = new
        if row.min() > most:
            return far, 0
    at = int(row.argmin())
    return int(row[at]), at


class Items:
    """Items of one block, their tables by length."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, seed: int = 6):
        self.vocab: dict[str, int] = {}
        self.names: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for name, text in items:
            if ws := words_of(text):
                self.names[tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws)].append(name)
        self.by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for ids in self.names:
            self.by_length[len(ids)].append(ids)
        self.edits = {n: int(n * (1 - similarity) + 1e-9) if n >= 5 else 0 for n in self.by_length}
        # word pairs by hash, a bit for each length of items; a wrong hit only lets a window through
        self.pairs = np.zeros(PAIR_SLOTS, np.uint64)
        self.bit = {n: np.uint64(1 << (i % 64)) for i, n in enumerate(sorted(self.by_length))}
        for ids in self.names:
            self.pairs[self.pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))] |= self.bit[len(ids)]
        runs = {a for ids in self.names for a, b, c in zip(ids, ids[1:], ids[2:]) if a == b == c}
        self.runs = np.array(sorted(runs), np.int64)
        self.longest = max(self.by_length, default=0)
        self.pad = max(self.edits.values(), default=0)
        random = np.random.default_rng(seed)
        self.word_mix = random.integers(0, 2**64, len(self.vocab) + 1, np.uint64, endpoint=False)
        self.step_mix = random.integers(0, 2**64, (WALKS, 2 * self.longest), np.uint64, endpoint=False)
        self.mix = random.integers(1, 2**63, (TABLES, SAMPLE), np.uint64) | np.uint64(1)
        self.coordinates = {n: np.stack([np.sort(random.choice(2 * n, min(SAMPLE, 2 * n), replace=False)) for _ in range(WALKS * TABLES)]).reshape(WALKS, TABLES, -1) for n in self.by_length}
        self.tables = {}
        for n, group in self.by_length.items():
            keys = self.keys(np.array(group), n)
            self.tables[n] = []
            for table in keys:
                order = np.argsort(table, kind="stable")
                self.tables[n].append((table[order], order))

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77) % PAIR_SLOTS

    def coins(self, walk: int, step: int, words: np.ndarray) -> np.ndarray:
        """0 or 1 for each word: whether the cursor moves on."""
        h = (self.word_mix[words] ^ self.step_mix[walk, step]) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(63)).astype(np.int64)

    def keys(self, windows: np.ndarray, n: int) -> list[np.ndarray]:
        """Hashes of the windows (rows of n ids), one array for each walk and table."""
        size = max(1, WINDOW_WORDS // n)
        parts = [self._keys(windows[i : i + size], n) for i in range(0, max(len(windows), 1), size)]
        return [np.concatenate(p) for p in zip(*parts)]

    def _keys(self, windows: np.ndarray, n: int) -> list[np.ndarray]:
        out = []
        rows = np.arange(len(windows))
        held = np.hstack([windows, np.zeros((len(windows), 1), windows.dtype)])  # the walk rests behind the end
        for r in range(WALKS):
            wanted = self.coordinates[n][r]
            picked = np.zeros((*wanted.shape, len(windows)), np.uint64)
            at, asked = np.zeros(len(windows), np.int64), defaultdict(list)
            for place in np.ndindex(wanted.shape):
                asked[int(wanted[place])].append(place)
            for j in range(int(wanted.max()) + 1):
                w = held[rows, at]
                for place in asked.get(j, ()):
                    picked[place] = w
                at = np.minimum(at + self.coins(r, j, w), n)
            for t in range(TABLES):
                h = (picked[t] * self.mix[t, : wanted.shape[1], None]).sum(0, dtype=np.uint64)
                out.append(h ^ (h >> np.uint64(31)))
        return out

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits): for each text and item the nearest place, the first among equals."""
        if not self.names:
            return
        ids, ends = [], []
        for t in texts:
            ws = words_of(t)
            ids.append(np.fromiter(map(self.vocab.get, ws, repeat(0)), np.int64, len(ws)))
            ids.append(np.zeros(self.pad + 1, np.int64))
        sizes = np.array([len(x) for x in ids[::2]])
        ends = np.cumsum(sizes + self.pad + 1) - self.pad - 1
        flat = np.concatenate(ids)
        known = np.r_[0, np.cumsum(flat > 0)]
        pairs = self.pairs[self.pair(flat[:-1], flat[1:])]
        pairs[(flat[:-1] == 0) | (flat[1:] == 0)] = 0
        pairs[1:][(flat[:-2] == flat[1:-1]) & (flat[1:-1] == flat[2:]) & ~np.isin(flat[1:-1], self.runs)] = 0
        paired = np.flatnonzero(pairs)
        pairs = pairs[paired]
        text_at = np.repeat(np.arange(len(texts)), sizes + self.pad + 1)
        best: dict[tuple[int, tuple[int, ...]], tuple[int, int, int]] = {}
        for n, group in self.by_length.items():
            k, items = self.edits[n], np.array(group)
            if len(flat) < n:
                continue
            need = n - 2 - 2 * k
            if need > 0:  # windows with so many pairs: from the first to the last of as many in a row
                at = paired[(pairs & self.bit[n]) > 0]
                first, last = at[: max(0, len(at) - need + 1)], at[need - 1 :]
                near = last - first <= n - 2
                low, high = np.maximum(last[near] - (n - 2), 0), np.minimum(first[near], len(flat) - n)
                size = np.maximum(high - low + 1, 0)
                starts = np.unique(np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()))
            else:
                starts = np.arange(len(flat) - n + 1)
            starts = starts[known[starts + n] - known[starts] >= n - k]
            starts = starts[starts + n <= ends[text_at[starts]] + k]
            many = max(1, min(1 << 14, WINDOW_WORDS // n))
            for i in range(0, len(starts), many):
                part = starts[i : i + many]
                keys = self.keys(flat[part[:, None] + np.arange(n)], n)
                found: set[tuple[int, int]] = set()
                for mine, (table, order) in zip(keys, self.tables[n]):
                    lo, hi = np.searchsorted(table, mine), np.searchsorted(table, mine, "right")
                    for x in np.flatnonzero(hi > lo):
                        found.update((int(part[x]), int(o)) for o in order[lo[x] : hi[x]])
                exact = set()
                for s, o in sorted(found):
                    t = int(text_at[s])
                    if (t, o) not in exact and s + n <= ends[t] and np.array_equal(flat[s : s + n], items[o]):
                        exact.add((t, o))
                        key, place = (t, group[o]), (0, s - int(ends[t] - sizes[t]), n)
                        best[key] = min(best.get(key, place), place)
                for s, o in sorted(found):
                    t = int(text_at[s])
                    if (t, o) in exact:
                        continue
                    key = (t, group[o])
                    most = min(k, best[key][0]) if key in best else k
                    edits, size = end_free_distance(items[o], flat[s : min(s + n + k, int(ends[t]))], most)
                    if edits <= most:
                        place = (edits, s - int(ends[t] - sizes[t]), size)
                        best[key] = min(best.get(key, place), place)
        for (t, item), (edits, first, size) in best.items():
            for name in self.names[item]:
                yield t, name, first, size, edits


def item_blocks(benchmark: DataFrame, size: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about `size` bytes, dealt by a hash of their id and text."""
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-total // size))
    for i in range(n):
        yield [tuple(r) for r in benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select(F.col("item_id").cast("long"), "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits, similarity): a row per document and item that it holds."""
    found = None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            held = Items(items, similarity)
            size = {name: len(ids) for ids, names in held.names.items() for name in names}
            for b in blocks(batches, "text"):
                rows = list(held.matches(b.column("text").to_pylist()))
                doc = b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]
                share = pa.array([1 - r[4] / size[r[1]] for r in rows], pa.float64())
                yield pa.RecordBatch.from_arrays([doc, *cols, share], ["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, edits long, similarity double")
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold no item, all columns kept."""
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            held = Items(items, similarity)
            for b in blocks(batches, "text"):
                bad = np.zeros(b.num_rows, bool)
                bad[[m[0] for m in held.matches(b.column("text").to_pylist())]] = True
                yield b.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark)

"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal), of at least max(`LEAST`, `TIMES` * q)
words, that no neighbouring word extends keeping the period.

The words of a block of texts become numbers, put side by side with a separator of its own after each text, so
that no repeat crosses texts. Periods up to `SHORT` are found by direct scans: for each lag, the stretches
where a word equals the one a lag later. Longer ones go by scales. A scale holds the periods P..Q with
Q = P + P // 3. It hashes the grams of k = Q words and keeps a position whose hash is the least of some window of
w = 2 * P - Q + 1 positions. Inside a run of period p in P..Q:

* grams at most p apart differ, because they hold a whole period and a smallest period has no equal rotations, so
  equal minimizers that follow each other are exactly p apart;
* the run has at least three periods, so at least p + 1 windows lie in it, and some window and the one p later choose
  positions p apart.

So every run of the scale is seeded by a pair of equal minimizers that follow each other, at the distance of its
period. Seeds are extended both ways by comparing hashes of prefixes, all at once by bisection, and each stretch is then
compared word by word; should a hash have lied, the lag is scanned directly. A multiple of a period gives the
same stretch again and the smallest one stays, because three periods of the multiple hold two of the smaller.
Cost is a few passes over the words for each scale, of which a text of n words has about log(n / 27) / log(4 / 3).

Null and empty texts have no words: no runs and empty strings. Repeated rows are reported each, null ids stay null
(and have no planted copies), an empty table gives no rows; only doc_id and text are read, other columns may
have any name. A text is never cut; memory is a few hundred bytes a word of the longest one or of a block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks

LEAST, TIMES = 24, 3
#: Lags up to this are scanned directly; up to a third of LEAST every run has LEAST words or more anyway.
SHORT = 8
#: Two primes below 2^31 and a base for each: hashes of grams are pairs of sums modulo these.
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525))
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Grams:
    """Hashes of all stretches of an array of numbers."""

    def __init__(self, words: np.ndarray):
        self.parts = []
        n = len(words)
        for prime, base in PRIMES:
            power = self._powers(base, n, prime)
            back = self._powers(pow(base, -1, prime), n, prime)
            terms = ((words.astype(np.uint64) * np.uint64(2654435761) + np.uint64(12345)) % np.uint64(prime)) * power
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self._mod(terms, prime), out=sums[1:])
            self.parts.append((prime, self._mod(sums, prime), back))

    @staticmethod
    def _mod(x: np.ndarray, prime: int) -> np.ndarray:
        return x - (x // np.uint64(prime)) * np.uint64(prime)  # division by a constant is vectorized, % is not

    @classmethod
    def _powers(cls, base: int, n: int, prime: int) -> np.ndarray:
        out = np.ones(max(n, 1), np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = cls._mod(out[:more] * np.uint64(pow(base, done, prime)), prime)
            done += more
        return out[:n]

    def all(self, k: int, n: int) -> np.ndarray:
        """Hash of the k words at each of the first n positions (n + k words at most are there)."""
        out = np.zeros(n, np.uint64)
        for prime, sums, back in self.parts:
            h = self._mod((sums[k : k + n] + np.uint64(prime) - sums[:n]), prime) * back[:n]
            out = (out << np.uint64(31)) | self._mod(h, prime)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the stretches of `size` words at a and at b have equal hashes."""
        same = np.ones(len(a), bool)
        for prime, sums, back in self.parts:
            at = [self._mod(self._mod(sums[x + size] + np.uint64(prime) - sums[x], prime) * back[x], prime) for x in (a, b)]
            same &= at[0] == at[1]
        return same

    def extend(self, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How far the words before a and b (a < b) agree, and the words from a and b on."""
        left, right = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        step = 1 << max(n - 1, 1).bit_length()
        while step:
            can = np.flatnonzero(b + right + step <= n)
            can = can[self.equal((a + right)[can], (b + right)[can], step)]
            right[can] += step
            can = np.flatnonzero(a - left - step >= 0)
            can = can[self.equal((a - left - step)[can], (b - left - step)[can], step)]
            left[can] += step
            step >>= 1
        return left, right


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or largest) of each w neighbours: one value per window."""
    pick = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :])


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some window of w neighbours."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _sliding(h, w, True)
    edge = np.zeros(w - 1, h.dtype)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), w, False) == h)


def lag_runs(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that keep the lag and are long enough for it."""
    if len(words) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(words) - lag + 2, np.int8)
    same[1:-1] = words[:-lag] == words[lag:]
    turn = np.diff(same)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + lag
    long = end - start >= max(LEAST, TIMES * lag)
    return start[long], end[long]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) rows of all runs, in order of start and period. `words` are texts side by side, longest
    first and each followed by a number that stands nowhere else; `sizes` are their words without it."""
    found: list[np.ndarray] = []

    def add(start: np.ndarray, end: np.ndarray, period: np.ndarray | int) -> None:
        found.append(np.stack([start, end, np.broadcast_to(period, start.shape)], axis=1))

    ends = np.cumsum(sizes + 1)
    long = int((sizes >= LEAST).sum())
    n = int(ends[long - 1]) if long else 0
    for lag in range(1, SHORT + 1):
        add(*lag_runs(words[:n], lag), lag)
    low = SHORT + 1
    grams = Grams(words[: int(ends[k - 1])]) if (k := int((sizes >= TIMES * low).sum())) else None
    while grams:
        high = low + low // 3
        texts = int((sizes >= TIMES * low).sum())  # a prefix, as sizes fall
        if not texts:
            break
        n = int(ends[texts - 1])
        h = grams.all(high, max(n - high + 1, 0))
        at = minimizers(h, 2 * low - high + 1)
        h = h[at]
        order = np.argsort(h, kind="stable")
        a, b = at[order[:-1]], at[order[1:]]
        seed = (h[order[:-1]] == h[order[1:]]) & (b - a >= low) & (b - a <= high)
        a, b = a[seed], b[seed]
        left, right = grams.extend(a, b, n)
        rows = np.unique(np.stack([a - left, b + right, b - a], axis=1), axis=0)
        rows = rows[rows[:, 1] - rows[:, 0] >= TIMES * rows[:, 2]]
        lied = set()
        for start, end, lag in rows.tolist():
            fits = np.array_equal(words[start : end - lag], words[start + lag : end])
            fits = fits and (start == 0 or words[start - 1] != words[start - 1 + lag]) and (end == n or words[end] != words[end - lag])
            if not fits:
                lied.add(lag)
        add(rows[:, 0], rows[:, 1], rows[:, 2])
        for lag in lied:
            found[-1] = found[-1][found[-1][:, 2] != lag]
            add(*lag_runs(words[:n], lag), lag)
        low = high + 1
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)  # multiples of a period give its stretch again
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place after a copy is planted; None where the text stays. A tenth of the ids has one."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def text_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words the (start, end, period) rows of its runs."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat: list[bytes] = []
    for k in order:
        flat.extend(texts[k])
        flat.append(b"")  # no word is empty; replaced by a number of its own below
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = sizes[order]
    ends = np.cumsum(sizes + 1)
    words[ends - 1] = len(coded.dictionary) + np.arange(len(ends))
    rows = find_runs(words, sizes)
    text = np.searchsorted(ends, rows[:, 0], side="right")
    rows[:, :2] -= (ends - sizes - 1)[text][:, None]
    out: list[np.ndarray] = [rows[:0]] * len(texts)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    for i, k in enumerate(order):
        out[k] = rows[cut[i] : cut[i + 1]]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words left when each run is cut to its first period; judged on the whole text, not on what is left."""
    if not len(runs):
        return words
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0)]


def _report(runs: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256); the run with the greatest exact exponent."""
    rows = [(int(s), int(e - s), int(p)) for s, e, p in runs]
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest()
    if not rows:
        return 0, None, None, None, None, digest
    top = rows[0]
    for r in rows[1:]:  # in order of start, then period: the first among equals stays
        if r[1] * top[2] > top[1] * r[2]:
            top = r
    return len(rows), *top, 1000 * top[1] // top[2], digest


def runs_report(docs: DataFrame, plant: bool = False, with_runs: bool = False) -> DataFrame:
    """A row per row of docs (doc_id, text): SCHEMA, and with `with_runs` also `runs`, the (start, length, period) of each
    run, and `collapsed`, the text that is left. `plant` puts copies into a tenth of the texts first (see `planted`)."""
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_runs else ""
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + ([pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()] if with_runs else [])
    names = [c.split()[0] for c in SCHEMA.split(", ")] + (["runs", "collapsed"] if with_runs else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            ids = b.column("doc_id").to_pylist()
            texts = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            if plant:
                for i, name in enumerate(ids):
                    at = planted(len(texts[i]), name)
                    if at is not None:
                        texts[i] = [texts[i][k] for k in at]
            out = []
            for name, words, runs in zip(ids, texts, text_runs(texts)):
                left = b" ".join(collapse(words, runs))
                row = (name, *_report(runs), hashlib.sha256(left).hexdigest())
                if with_runs:
                    row += ([{"start": int(s), "length": int(e - s), "period": int(p)} for s, e, p in runs], left.decode())
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + more)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)

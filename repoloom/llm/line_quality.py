"""Document quality from a linear-chain conditional random field over lines.

Every line (text between newlines) gets a label, good or bad. Features of a line are shares counted on its bytes and
words (`OWN`), those of the line before and after, and whether it is the first or last; they score the label, and
weights of label pairs tie a line to the next one. Forward and backward passes give each line's
probability of being good; their mean, weighted by the line's characters plus one, becomes the score by a logistic curve.

Labels exist for documents only, so lines are learned in rounds. A logistic regression on single lines by their own features, each
with its document's label and both labels of equal weight, tells lines that only bad documents have from those that
stand in good ones too. Then every line of a good document counts as good, and a line of a bad one as the model
says, its worst line always as bad; the field is fitted to these labels by its exact likelihood
(L-BFGS, convex), and once more to the labels that it gives itself.

The passes over a chain are products of 2 x 2 matrices, taken in pieces side by side, so a text with
very many lines costs no more than many texts with few. The first line of a text has a matrix with equal rows, which
forgets what came before: a whole block of texts is one chain.

Training takes at most about `TRAIN_ROWS` labelled documents, chosen by a hash of the id, and of these, in order of the
hash, as many as have `TRAIN_LINES` lines together; ids that repeat are learned from once. Scoring reads whole texts.

Null and empty texts are one empty line. Without labels of both kinds nothing can be learned and every score is 0.5.
Labels of one id that differ count as bad; null labels and ids are left out. Repeated rows are scored each; null ids
are kept and not held out. An empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks, stored

TRAIN_ROWS, TRAIN_LINES = 20_000, 60_000
THRESHOLD = 0.3
RIDGE, ROUNDS = 1.0, 2
OWN = [
    "length", "letters", "upper", "digits", "punctuation", "doubled punctuation", "words that end in punctuation",
    "words without letters", "words equal to the one before", "repeated words", "word length", "copies in the text", "empty", "beyond ascii",
]
N_FEATURES = 3 * len(OWN) + 3

LETTER, UPPER, DIGIT, PUNCT, SPACE, HIGH, LATER = (1 << i for i in range(7))


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1] = LETTER
    kind[ord("A") : ord("Z") + 1] = LETTER | UPPER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[c for c in range(33, 127) if not chr(c).isalnum()]] = PUNCT
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[128:192] = LATER  # bytes of a character after its first
    kind[192:] = LETTER | HIGH
    return kind


KIND = _byte_kinds()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of every line, its characters, the text it belongs to); a text has one line more than newlines."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    starts = np.r_[0, ends[:-1]]
    n = len(ends)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    kind = KIND[data]
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64).astype(float)
    chars = count(kind != LATER) - 1
    letters, punct = count((kind & LETTER) > 0), kind == PUNCT
    twice = punct.copy()
    twice[1:] &= data[1:] == data[:-1]
    twice[:1] = False

    dark = kind != SPACE
    word_starts = np.flatnonzero(dark & np.r_[True, ~dark[:-1]])
    word_ends = np.flatnonzero(dark & np.r_[~dark[1:], True]) + 1
    line = np.searchsorted(ends, word_starts, side="right")
    words = np.bincount(line, minlength=n).astype(float)
    of_words = lambda mask: np.bincount(line[mask], minlength=n).astype(float)
    if len(word_starts):
        sizes = word_ends - word_starts
        power = np.ones(1 << 10, np.uint64)  # repeats in longer words
        np.cumprod(np.full(len(power) - 1, 0x9E3779B97F4A7C15, np.uint64), out=power[1:])
        at = np.flatnonzero(dark)
        terms = (data[at].astype(np.uint64) + np.uint64(1)) * power[(at - np.repeat(word_starts, sizes)) % len(power)]
        h = np.add.reduceat(terms, np.cumsum(sizes) - sizes, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        again = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])]
        wide = np.uint64(max(n - 1, 1).bit_length())  # line above, as much of the hash below as there is room for
        key = np.sort((line.astype(np.uint64) << (np.uint64(64) - wide)) | (h >> wide))
        new = np.r_[True, key[1:] != key[:-1]]
        distinct = np.bincount((key[new] >> (np.uint64(64) - wide)).astype(np.int64), minlength=n)
        bare = np.add.reduceat((kind & (LETTER | DIGIT)) > 0, word_starts, dtype=np.int64) == 0
        place = np.arange(len(h)) - np.r_[0, np.cumsum(words)].astype(np.int64)[line]
        name = np.zeros(n, np.uint64)
        np.add.at(name, line, h * (2 * place + 1).astype(np.uint64))
        tail = kind[word_ends - 1] == PUNCT
    else:
        again = bare = tail = np.zeros(0, bool)
        distinct, name = np.zeros(n), np.zeros(n, np.uint64)
    order = np.lexsort((name, text))
    same = (name[order][1:] == name[order][:-1]) & (text[order][1:] == text[order][:-1])
    copy = np.zeros(n, bool)
    copy[order[1:][same]] = True
    copy[order[:-1][same]] = True

    c, w = np.maximum(chars, 1), np.maximum(words, 1)
    own = [
        np.log1p(chars) / 5, letters / c, count((kind & UPPER) > 0) / np.maximum(letters, 1), count(kind == DIGIT) / c,
        count(punct) / c, np.minimum(count(twice) / w, 4) / 2, of_words(tail) / w, of_words(bare) / w, of_words(again) / w,
        1 - distinct / w, np.log1p(letters / w) / 2, (copy & (words > 0)) * 1.0, (words == 0) * 1.0, count((kind & HIGH) > 0) / c,
    ]
    return np.stack(own, axis=1), chars, text


def with_neighbours(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Features of each line: its own, those of the lines before and after in its text, first, last, and a constant."""
    first, last = np.r_[True, text[1:] != text[:-1]], np.r_[text[1:] != text[:-1], True]
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))])


def _times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of rows of 2 x 2 matrices, brought to a sum of 1, and the logarithms of what was taken out."""
    c = np.einsum("nij,njk->nik", a, b)
    size = c.sum((1, 2))
    return c / size[:, None, None], np.log(size)


def _scan(steps: np.ndarray) -> tuple[np.ndarray, float]:
    """(1, 1) times the product of the first 1..n matrices, each scaled to a sum of 1, and the log of the last one's sum."""
    n = len(steps)
    width = max(1, int(np.ceil(np.sqrt(n))))
    pieces = -(-n // width)
    held = np.tile(np.eye(2), (pieces * width, 1, 1))
    held[:n] = steps
    held = held.reshape(pieces, width, 2, 2)
    done, logs = np.empty_like(held), np.zeros((pieces, width))
    done[:, 0] = held[:, 0]
    for k in range(1, width):
        done[:, k], more = _times(done[:, k - 1], held[:, k])
        logs[:, k] = logs[:, k - 1] + more
    carry, total = np.empty((pieces, 2)), 0.0
    v = np.ones(2)
    for p in range(pieces):
        carry[p] = v
        v = v @ done[p, -1]
        total += logs[p, -1] + np.log(v.sum())
        v = v / v.sum()
    out = np.einsum("pi,pwij->pwj", carry, done).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True), total


def marginals(node: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of good per line, expected pairs of labels (2, 2), logarithm of the sum over all labellings).

    `node` scores good against bad, `pairs[a, b]` a line of label a before one of label b (0 bad, 1 good)."""
    node = np.clip(node, -40, 40)
    emit = np.exp(np.stack([-node / 2, node / 2], axis=1))
    steps = np.where(first[:, None, None], 1.0, np.exp(pairs)) * emit[:, None, :]
    alpha, log_sum = _scan(steps)
    # (1, 1) forgets at the start of the chain: the first matrix has equal rows, so the sum counts it twice
    log_sum += node.sum() / 2 - np.log(2)
    beta = np.ones((len(node), 2))
    if len(node) > 1:
        beta[:-1] = _scan(steps[:0:-1].transpose(0, 2, 1))[0][::-1]
    both = alpha * beta
    good = both[:, 1] / both.sum(1)
    joint = alpha[:-1, :, None] * steps[1:] * beta[1:, None, :]
    joint = joint[~first[1:]]
    return good, (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(joint) else np.zeros((2, 2)), log_sum


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 100, memory: int = 10) -> np.ndarray:
    """L-BFGS with halving steps for a smooth convex function that returns its value and gradient."""
    value, slope = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.abs(d).max())
        for (s, y), a in zip(past, reversed(kept)):
            d += (a - (y @ d) / (s @ y)) * s
        size = 1.0
        while size > 1e-9:
            new = w - size * d
            v, g = f(new)
            if v <= value - 1e-4 * size * (slope @ d):
                break
            size /= 2
        else:
            break
        if (new - w) @ (g - slope) > 1e-12:
            past = [*past[1 - memory :], (new - w, g - slope)]
        small = value - v < 1e-7 * max(1.0, abs(value))
        w, value, slope = new, v, g
        if small:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression; the last column is the constant and isn't shrunk."""
    shrink = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (shrink * w * w).sum() / 2), x.T @ (weight * (p - y)) + shrink * w

    return minimize(loss, np.zeros(x.shape[1]))


def fit_field(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of the lines' features and, behind them, of the label pairs bad-good, good-bad and good-good."""
    k = x.shape[1]
    inner = ~first[1:]
    a, b = y[:-1][inner].astype(int), y[1:][inner].astype(int)
    seen = np.bincount(2 * a + b, minlength=4).reshape(2, 2)
    shrink = np.r_[np.full(k - 1, RIDGE), 1e-6, np.full(3, RIDGE)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        node, pairs = x @ w[:k], np.array([[0.0, w[k]], [w[k + 1], w[k + 2]]])
        good, expected, log_sum = marginals(node, first, pairs)
        value = log_sum - (node * y).sum() - (seen * pairs).sum()
        slope = np.r_[x.T @ (good - y), (expected - seen).ravel()[1:]]
        return float(value + (shrink * w * w).sum() / 2), slope + shrink * w

    return minimize(loss, w)


class Model:
    """Weights of features and label pairs, and the curve from the mean probability to the score."""

    def __init__(self, weights: np.ndarray | None = None, curve: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.curve = weights, curve

    def good_lines(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        w = self.weights
        first = np.r_[True, text[1:] != text[:-1]]
        return marginals(x @ w[:N_FEATURES], first, np.array([[0.0, w[N_FEATURES]], [w[N_FEATURES + 1], w[N_FEATURES + 2]]]))[0]

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good, characters, text) of every line."""
        own, chars, text = line_features([(t or "").encode() for t in texts])
        if self.weights is None:
            return np.full(len(own), 0.5), chars, text
        return self.good_lines(with_neighbours(own, text), text), chars, text

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        return self.bent(mean_logit(*self.lines(texts), len(texts)))

    def bent(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * logit + self.curve[1], -40, 40)))


def mean_logit(good: np.ndarray, chars: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Log odds of the mean probability of the lines of each text, weighted by characters plus one."""
    mean = np.bincount(text, good * (chars + 1), n) / np.bincount(text, chars + 1, n)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit(own: np.ndarray, chars: np.ndarray, text: np.ndarray, quality: np.ndarray) -> Model:
    """A model from the lines of labelled texts; `quality` per text, with both labels there."""
    x, label = with_neighbours(own, text), quality[text]
    first = np.r_[True, text[1:] != text[:-1]]
    share = label.mean()
    alone = np.hstack([own, np.ones((len(own), 1))])  # a good line beside a bad one stands in bad documents only
    single = fit_logistic(alone, label, np.where(label == 1, 0.5 / share, 0.5 / (1 - share)))
    good, model = 1 / (1 + np.exp(-np.clip(alone @ single, -40, 40))), Model()
    weights = np.r_[single[:-1], np.zeros(N_FEATURES - len(single)), single[-1], np.zeros(3)]
    for _ in range(ROUNDS):
        y = np.where(label == 1, 1.0, (good > 0.5) * 1.0)
        order = np.lexsort((good, text))
        worst = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        y[worst[label[worst] == 0]] = 0
        weights = fit_field(x, first, y, weights)
        model = Model(weights)
        good = model.good_lines(x, text)
    logit = mean_logit(good, chars, text, len(quality))
    a, b = fit_logistic(np.stack([logit, np.ones(len(logit))], axis=1), quality, np.ones(len(quality)), ridge=0.1)
    model.curve = (float(a), float(b))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> DataFrame:
    """(doc_id, text, quality) of the labelled documents to learn from; at most about `rows`, with `lines` lines together."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order, n = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 40)), known.count()
    few = known.withColumn("_order", order).filter(F.col("_order") < int((1 << 40) * min(1.0, rows / max(n, 1))))
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `few` has about `rows` rows
    one = stored(found.groupBy("doc_id", "quality", "_order").agg(F.min("text").alias("text")))
    size = F.coalesce(F.length(F.regexp_replace("text", "[^\n]+", "")), F.lit(0)) + 1
    taken, most = 0, 1 << 40
    for r in one.select("_order", size.alias("n")).orderBy("_order").toLocalIterator():  # two numbers a row of the sample
        taken += r["n"]
        if taken > lines:
            most = r["_order"]
            break
    return one.filter(F.col("_order") < most).select("doc_id", "text", "quality")


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Model:
    train = training_rows(docs, labels, rows, lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            own, chars, text = line_features([(t or "").encode() for t in b.column("text").to_pylist()])
            cut = np.searchsorted(text, np.arange(b.num_rows + 1))
            parts = [(own[i:j].astype("<f4").tobytes(), chars[i:j].astype("<i8").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            cols = [b.column("doc_id"), b.column("quality"), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "quality", "own", "chars"])

    got = train.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, quality int, own binary, chars binary")
    got = sorted(got.collect(), key=lambda r: r["doc_id"])  # a few numbers a line of the sample, which is bounded
    quality = np.array([r["quality"] for r in got], float)
    if not (quality == 1).any() or not (quality == 0).any():
        return Model()
    own = np.concatenate([np.frombuffer(r["own"], "<f4").reshape(-1, len(OWN)) for r in got]).astype(float)
    chars = [np.frombuffer(r["chars"], "<i8") for r in got]
    text = np.repeat(np.arange(len(got)), [len(c) for c in chars])
    return fit(own, np.concatenate(chars).astype(float), text, quality)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) per row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            s = model.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, text, good double) per line of every row, lines numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts = b.column("text").to_pylist()
            good, _, text = model.lines(texts)
            line = np.arange(len(text)) - np.searchsorted(text, text)
            ids = b.column("doc_id").take(pa.array(text, pa.int64()))
            words = pa.array([x for t in texts for x in (t or "").split("\n")], pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(line, pa.int64()), words, pa.array(good)], ["doc_id", "line", "text", "good"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, line long, text string, good double")


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels)).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))

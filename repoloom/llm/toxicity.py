"""Toxicity scores: a learned lexicon, Levenshtein automata over its trie, and context windows.

Training (labelled rows, at most about `TRAIN_ROWS`, chosen by a hash of the id): a word enters the
lexicon if the lower confidence bound of its share of toxic documents is `LEAST_SHARE` or more.
Near copies count once, as one group per least hash of a word pair. Windows of `CONTEXT` words around hits
give words of context their log odds, and a logistic regression weighs the counts of hits.

Scoring: the lexicon is a trie. The Levenshtein automata of all its terms run over the trie at
once; their common states are made deterministic as they are met and kept, so most words leave
the automaton after a few characters. Terms of 5 letters or more are found with one edit,
of 8 or more with two. A hit between quotation marks counts apart from a plain one, and the window
around a hit says whether it reads as abuse or as a report of it.

Scores are between 0 and 1. Null and empty texts have the score of a text without hits. Without
labels of both kinds nothing can be learned and every score is 0. Repeated rows are scored each;
labels of one id that differ count as toxic; null labels are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks, stored

TRAIN_ROWS = 20_000
LEAST_SHARE = 0.6
CONTEXT = 5
THRESHOLD = 0.7
#: Deterministic states and known words are kept up to so many.
MOST_KEPT = 500_000

WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
RUN = re.compile(r"(.)\1{2,}")
QUOTES = '"“”„«»'


def edits_allowed(term: str) -> int:
    return (len(term) >= 5) + (len(term) >= 8)


class Lexicon:
    """Trie of the terms, run together with their Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for term in terms:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                at = self.children[at][c]
            self.ends[at] = term
        self.most = max(map(edits_allowed, terms), default=0)
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[tuple[int, str], int] = {}
        self.words: dict[str, tuple[str, int] | None] = {}
        self.first = self._state({0: 0}) if self.ends else -1

    def _state(self, cost: dict[int, int]) -> int:
        """Number of the state (trie node -> edits), after skipping letters of terms; -1 if none."""
        todo = sorted(cost, key=cost.get)
        for node in todo:  # grows while it runs; a skipped letter costs one edit
            if cost[node] < self.most:
                for child in self.children[node].values():
                    if cost.get(child, 99) > cost[node] + 1:
                        cost[child] = cost[node] + 1
                        todo.append(child)
        if not cost:
            return -1
        key = tuple(sorted(cost.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        cost: dict[int, int] = {}
        for node, e in self.states[state]:
            reached = [(child, e + (letter != c)) for letter, child in self.children[node].items()] + [(node, e + 1)]
            for child, n in reached:
                if n <= self.most and n < cost.get(child, 99):
                    cost[child] = n
        return self._state(cost)

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and how many; the first in order among equals."""
        if word in self.words:
            return self.words[word]
        if len(self.words) + len(self.moves) > MOST_KEPT:
            self._reset()
        state = self.first
        for c in RUN.sub(r"\1", word):
            if state < 0:
                break
            key = (state, c)
            if key not in self.moves:
                self.moves[key] = self._move(state, c)
            state = self.moves[key]
        near = [(e, self.ends[n]) for n, e in self.states[state] if n in self.ends and e <= edits_allowed(self.ends[n])] if state >= 0 else []
        found = min(near)[::-1] if near else None
        self.words[word] = found
        return found


def hits(text: str | None, lexicon: Lexicon) -> tuple[int, list[tuple[str, int, bool, list[str]]]]:
    """Number of words, and for each hit the term, its edits, whether it is quoted, and the words around it."""
    low = (text or "").lower()
    words = WORD.findall(low)
    found = {w for w in set(words) if lexicon.find(w)}
    out = []
    if found:
        marks = [i for i, c in enumerate(low) if c in QUOTES]
        quoted = [(a, b) for a, b in list(pairwise(marks))[::2] if b - a <= 400 and "\n" not in low[a:b]]
        spans = [m.span() for m in WORD.finditer(low)]
        q = 0
        for i, w in enumerate(words):
            if w in found:
                term, edits = lexicon.find(w)
                while q < len(quoted) and quoted[q][1] < spans[i][0]:
                    q += 1
                around = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
                out.append((term, edits, q < len(quoted) and quoted[q][0] < spans[i][0], around))
    return len(words), out


class Model:
    """Lexicon, log odds of context words, and the weights of the features; all bounded by the training sample."""

    def __init__(self, terms: list[str], context: dict[str, float], weights: np.ndarray | None):
        self.terms, self.context, self.weights = terms, context, weights

    def features(self, text: str | None, lexicon: Lexicon) -> list[float]:
        n, found = hits(text, lexicon)
        plain = sum(1 for _, e, q, _ in found if not e and not q)
        near = sum(1 for _, e, q, _ in found if e and not q)
        quoted = sum(1 for _, _, q, _ in found if q)
        odds = [np.mean([self.context.get(w, 0.0) for w in around] or [0.0]) for *_, around in found]
        return [1.0, np.log1p(plain), np.log1p(near), np.log1p(quoted), max(odds, default=0.0), 100 * len(found) / (n + 20)]

    def scores(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([self.features(t, lexicon) for t in texts]).reshape(-1, 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents that aren't held out."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(n, 1))))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")  # as many as `rows` ids


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    train = stored(training_rows(docs, labels, rows))
    kinds = dict(train.groupBy("toxic").count().collect())
    if not kinds.get(0) or not kinds.get(1):
        return Model([], {}, None)

    words = train.select("toxic", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+").alias("all"))
    pairs = F.zip_with("all", F.slice("all", 2, F.size("all")), lambda a, b: F.xxhash64(a, b))
    grouped = words.select("toxic", F.array_distinct("all").alias("ws"), F.array_min(pairs).alias("group"))
    votes = grouped.select("toxic", "group", F.explode("ws").alias("word")).filter("length(word) between 3 and 30")
    votes = votes.groupBy("word", "group").agg(F.avg("toxic").alias("t")).groupBy("word").agg(F.sum(F.when(F.col("t") > 0.5, 1).otherwise(0)).alias("t"), F.count("*").alias("n"))
    share, z2 = F.col("t") / F.col("n"), 1.64**2
    low = (share + z2 / (2 * F.col("n")) - F.sqrt(z2 * (share * (1 - share) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
    terms = sorted(r[0] for r in votes.filter(low >= LEAST_SHARE).select("word").collect())  # at most the sample's words

    def context_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for b in blocks(batches, "text"):
            out = [(w, y) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()) for *_, around in hits(t, lexicon)[1] for w in around]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["word", "toxic"])

    near = train.mapInArrow(context_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter("n >= 5").collect()
    total_t, total = sum(r["t"] for r in near), sum(r["n"] for r in near)
    prior = np.log((total_t + 5) / (total - total_t + 5))
    context = {r["word"]: float(np.log((r["t"] + 5) / (r["n"] - r["t"] + 5)) - prior) for r in near}
    model = Model(terms, context, None)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for b in blocks(batches, "text"):
            x = [list(map(float, model.features(t, lexicon))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    got = train.mapInArrow(features, "x array<double>, toxic int").collect()  # six numbers a row of the sample
    model.weights = fit_weights(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) per row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for b in blocks(batches, "text"):
            s = model.scores(b.column("text").to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for b in blocks(batches, "text"):
            yield b.filter(pa.array(model.scores(b.column("text").to_pylist(), lexicon) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels)).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))

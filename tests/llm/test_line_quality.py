"""The line field against all labellings, features against plain counting, and held-out documents."""

import itertools
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoloom.llm import line_quality

DOCS = "doc_id long, text string, lang string, quality int, score double, held_out string"


@pytest.mark.parametrize("seed", range(6))
def test_marginals_equal_the_sum_over_all_labellings(seed):
    rnd = np.random.default_rng(seed)
    for n in range(1, 9):
        node, pairs, first = rnd.normal(size=n) * 3, rnd.normal(size=(2, 2)) * 2, rnd.random(n) < 0.3
        first[0] = True
        total, good, expected = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            inner = [i for i in range(1, n) if not first[i]]
            p = np.exp(node @ np.array(y) + sum(pairs[y[i - 1], y[i]] for i in inner))
            total, good = total + p, good + p * np.array(y)
            for i in inner:
                expected[y[i - 1], y[i]] += p
        got = line_quality.marginals(node, first, pairs)
        assert np.allclose(got[0], good / total) and np.allclose(got[1], expected / total) and np.isclose(got[2], np.log(total))


def test_slope_of_the_field_is_that_of_its_value(monkeypatch):
    rnd = np.random.default_rng(3)
    x, first, y = rnd.normal(size=(40, 4)), rnd.random(40) < 0.2, (rnd.random(40) < 0.5) * 1.0
    first[0] = True
    seen = []
    monkeypatch.setattr(line_quality, "minimize", lambda f, w: seen.append(f) or w)
    w = line_quality.fit_field(x, first, y, rnd.normal(size=7))
    value, slope = seen[0](w)
    for i in range(7):
        step = np.eye(7)[i] * 1e-5
        assert np.isclose((seen[0](w + step)[0] - seen[0](w - step)[0]) / 2e-5, slope[i], rtol=1e-4, atol=1e-5)


def test_minimum():
    a = np.diag([1.0, 30.0, 200.0])
    got = line_quality.minimize(lambda w: (float(w @ a @ w / 2 - w.sum()), a @ w - 1), np.zeros(3), steps=200)
    assert np.allclose(got, 1 / np.diag(a), atol=1e-3)


def plain_own(text):
    """Own features of each line by counting characters and words one by one."""
    rows, lines = [], text.split("\n")
    marks = set(string.punctuation)
    for line in lines:
        words = line.replace("\x0b", " ").split()
        c, w = max(len(line), 1), max(len(words), 1)
        letter = lambda ch: ch.isascii() and ch.isalpha() or ord(ch) > 127
        letters = sum(map(letter, line))
        data = line.encode()
        rows.append([
            np.log1p(len(line)) / 5, letters / c, sum(ch in string.ascii_uppercase for ch in line) / max(letters, 1), sum(ch in string.digits for ch in line) / c,
            sum(ch in marks for ch in line) / c, min(sum(a == b and chr(a) in marks for a, b in zip(data, data[1:])) / w, 4) / 2,
            sum(x[-1] in marks for x in words) / w, sum(not any(letter(ch) or ch.isdigit() for ch in x) for x in words) / w,
            sum(a == b for a, b in zip(words, words[1:])) / w, 1 - len(set(words)) / w, np.log1p(letters / w) / 2,
            float(bool(words) and sum(o.split() == line.split() for o in lines) > 1), float(not words), sum(ord(ch) > 127 for ch in line) / c,
        ])
    return np.array(rows)


def test_features_equal_plain_counting():
    rnd = random.Random(2)
    texts = ["", "\n", "one", "a a a!! b!! ||\n\n| x |\nÉTÉ été 12 3.4\na a a!! b!! ||", "x" * 3000 + " y\n"]
    texts += ["".join(rnd.choice("abcXYZé1 .!|\n ") for _ in range(rnd.randrange(200))) for _ in range(60)]
    own, chars, text = line_quality.line_features([t.encode() for t in texts])
    want = np.concatenate([plain_own(t) for t in texts])
    assert own.shape == want.shape
    bad = np.argwhere(~np.isclose(own, want))
    assert not len(bad), [(line_quality.OWN[j], own[i, j], want[i, j]) for i, j in bad[:5]]
    assert chars.tolist() == [len(x) for t in texts for x in t.split("\n")] and np.bincount(text).tolist() == [t.count("\n") + 1 for t in texts]


def test_a_long_chain_equals_single_texts():
    rnd = np.random.default_rng(5)
    model = line_quality.Model(rnd.normal(size=line_quality.N_FEATURES + 3), (1.5, -0.5))
    texts = [None, "", *("\n".join("w" * int(k) for k in rnd.integers(0, 9, n)) for n in (1, 2, 50, 3000, 7))]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def junk(rnd, n):
    return " ".join(f"{rnd.choice(['ab', 'cd', 'ef'])}{rnd.choice(['$$$', '!!', '%%%'])}" for _ in range(n))


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghi", k=rnd.randrange(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        lines = [prose(rnd, rnd.randrange(4, 20)) for _ in range(rnd.randrange(1, 8))]
        if i % 3 == 0:
            at = rnd.randrange(len(lines) + 1)
            lines[at:at] = [junk(rnd, 25) for _ in range(2 + len(lines))]
        rows.append((i, "\n".join(lines), "en", 9, -1.0, "clash"))
        labels.append((i, int(i % 3 > 0), 0, "clash"))
    labels += [(None, 0, 0, None), (0, None, None, None), (9999, 1, 0, None), (3, 1, 0, "differs, counts as bad")]
    rows += [(400, None, None, None, None, None), (401, "", None, None, None, None), (402, "\n\n", "", None, None, None), (None, prose(rnd, 30), None, None, None, None)] + [rows[0]] * 50
    return spark.createDataFrame(rows, DOCS).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").cache()


def test_learned_lines_and_documents(spark, corpus):
    docs, labels = corpus
    model = line_quality.learn(docs, labels)
    got = line_quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert all((by_id[i] >= line_quality.THRESHOLD) == (i % 3 > 0) for i in range(300)) and None in by_id
    lines = line_quality.label_lines(docs.filter("doc_id < 300"), model).collect()
    right = [(r.good > 0.5) == (not any(c in r.text for c in "$!%")) for r in lines]
    assert np.mean(right) > 0.97  # lines of bad documents are told apart, although only documents have labels
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_nothing_to_learn_and_empty_tables(spark, corpus):
    docs, labels = corpus
    model = line_quality.learn(docs, labels.filter("quality = 1 or quality is null"))
    assert {r.score for r in line_quality.score(docs, model).collect()} == {0.5}
    assert line_quality.score(docs.filter(F.lit(False)), model).count() == 0
    assert line_quality.learn(docs.filter(F.lit(False)), labels).weights is None
    assert line_quality.learn(docs, labels.filter(F.lit(False))).weights is None


def test_training_sample_is_bounded_and_held_out_rows_stay_out(spark, corpus):
    docs, labels = corpus
    all_rows = line_quality.training_rows(docs, labels).collect()
    ids = [r.doc_id for r in all_rows]
    assert len(ids) == len(set(ids)) and not docs.filter(F.col("doc_id").isin(ids)).filter(line_quality.held_out()).count()
    some = line_quality.training_rows(docs, labels, lines=200).collect()
    assert 0 < sum(r.text.count("\n") + 1 for r in some) <= 200 and {r.doc_id for r in some} < set(ids)


def test_query_on_held_out_documents(spark, sf):
    at = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    got = line_quality.op12_line_quality(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97 and got.score[got.quality == 1].min() > got.score[got.quality == 0].median()
    assert line_quality.op12_line_quality(spark, at).count() == spark.read.parquet(f"{at}/documents.parquet").count()

"""Decontamination: the distance, reported places, memory for long items, and odd tables."""

import random
import tracemalloc

import numpy as np
import pytest

from repoloom.llm import decontamination as de


def plain_distance(item, text):
    """(edits, length) of the nearest beginning, the shortest among equals."""
    row = list(range(len(text) + 1))
    for i, w in enumerate(item, 1):
        last, row = row, [i]
        for j, v in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (v != w)))
    return min((e, n) for n, e in enumerate(row))


def test_distance_equals_the_plain_one():
    rnd = random.Random(1)
    for _ in range(1500):
        item = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        text = [rnd.randrange(4) for _ in range(rnd.randrange(0, 18))]
        want, most = plain_distance(item, text), rnd.randrange(0, 12)
        got = de.end_free_distance(np.array(item), np.array(text, np.int64), most)
        assert got == (want if want[0] <= most else (most + 1, 0)), (item, text, most)


def edited(rnd, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        at = rnd.randrange(len(words))
        words[at : at + rnd.randrange(2)] = rnd.choices(vocabulary, k=rnd.randrange(2))
    return words


@pytest.mark.parametrize("words_at_once", [1 << 21, 400])
def test_reported_edits_and_places(spark, monkeypatch, words_at_once):
    monkeypatch.setattr(de, "WINDOW_WORDS", words_at_once)
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: rnd.choices(vocabulary, k=rnd.randrange(4, 40)) for i in range(25)}
    texts = {}
    for i in range(120):
        some = rnd.choice(list(items.values()))
        texts[i] = rnd.choices(vocabulary, k=rnd.randrange(30)) + edited(rnd, some, rnd.randrange(3), vocabulary) + rnd.choices(vocabulary, k=rnd.randrange(30))
    table = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word, r.n_words) for r in de.leaks(table(texts, "doc_id"), table(items, "item_id")).collect()}
    want = {}
    for t, text in texts.items():
        for i, item in items.items():
            k = int(len(item) * 0.2 + 1e-9) if len(item) >= 5 else 0
            places = ((*plain_distance(item, text[s : s + len(item) + k]), s) for s in range(len(text) - len(item) + k + 1))
            near = min(((e, s, n) for e, n, s in places if e <= k), default=None)
            if near:
                want[t, i] = near
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 60
    for key, (edits, first, size) in got.items():
        assert plain_distance(items[key[1]], texts[key[0]][first : first + size])[0] == edits >= want[key][0]
    assert np.mean([got[key] == want[key] for key in got]) >= 0.97


def test_a_long_item_needs_little_memory():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(20_000)]
    rnd.shuffle(words)
    tracemalloc.start()
    held = de.Items([(1, " ".join(words)), (2, "five words stand right here")], 0.8)
    assert [m[1] for m in held.matches(["and five words stand right here", None, " ".join(words[:200])])] == [2]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_a_long_passage_is_found():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    item = rnd.choices(vocabulary, k=1500)
    text = rnd.choices(vocabulary, k=300) + edited(rnd, item, 6, vocabulary) + rnd.choices(vocabulary, k=300)
    (_, name, first, size, edits), = de.Items([(7, " ".join(item))], 0.8).matches([" ".join(text)])
    assert name == 7 and edits <= 6 and plain_distance(item, text[first : first + size])[0] == edits


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_odd_tables(spark, monkeypatch, size):
    monkeypatch.setattr(de, "ITEM_BYTES", size)
    monkeypatch.setattr(de.item_blocks, "__defaults__", (size,))
    schema = "{} long, text string, edits long, first_word string, doc_id_ string, item string"
    docs = [(1, "one two three four five six", 1, "x", "", ""), (1, "one two three four five six", 1, "x", "", ""), (None, "ONE two, three four five!", 1, "x", "", ""), (2, None, 1, "x", "", ""), (3, "", 1, "x", "", "")]
    items = [(5, "One two three four five", 2, "y", "", ""), (6, "one two three four five", 2, "y", "", ""), (None, "two three", 2, "y", "", ""), (7, None, 2, "y", "", ""), (8, "...", 2, "y", "", "")]
    d, b = spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id"))
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.first_word, r.n_words, r.edits) for r in de.leaks(d, b).collect()))
    assert got == sorted([(x, i, f, n, 0) for x in (0, 1, 1) for i, f, n in ((5, 0, 5), (6, 0, 5), (0, 1, 2))])
    kept = de.without_leaks(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert de.leaks(d, b.limit(0)).count() == 0 and de.leaks(d.limit(0), b).count() == 0 and de.without_leaks(d, b.limit(0)).count() == 5

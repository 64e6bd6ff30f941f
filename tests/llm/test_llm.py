"""Brute force, round trips and edge cases for the operators of repoloom.llm."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repoloom.llm import decontamination, embedding_dedup, licenses, packing, replies, simhash, suffix_dedup, token_counts, token_files, toxicity
from repoloom.llm.components import components
from repoloom.llm.subword import Subwords

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def some_texts(seed=1):
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice("the of red blue écrire größe stone river idea moves Quick-ly it's 12 4a".split()) + str(rnd.randrange(60)) for _ in range(n))
    shared, long = say(60), say(2500)
    texts = [None, "", " \n\t ", "x", "one two", long, long, long + " end", shared, say(20) + " " + shared + " " + say(30), "ab" * 400, "a" * 900]
    texts += [say(rnd.randrange(1, 120)) for _ in range(25)] + [say(10) + "\n\n" + shared + "é" for _ in range(3)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", None) for i, t in enumerate(some_texts())]
    return spark.createDataFrame([*rows, rows[6], (None, "no id", None, None, None, None, None)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_subwords_equal_the_library(path):
    sub, rnd = Subwords(path), random.Random(3)
    texts = ["".join(rnd.choices("ab'sT. \n,1é <|x\t　", k=rnd.randint(0, 16))) for _ in range(4000)]
    texts += ["<|endoftext|> hi<|endoftext|>", "İstanbul ΣΑΣ été́", "a\n\nb \n c  d\n \ne", "'tis don't 're"] + [t for t in some_texts() if t]
    for text, ids in zip(texts, sub.encode(texts)):
        assert ids.tolist() == sub.tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_elias_fano_round_trip():
    rnd = np.random.default_rng(1)
    for n, bound in ((1, 0), (1, 5), (3, 10**6), (2000, 5000), (500, 10**9)):
        v = np.sort(rnd.integers(0, bound + 1, n))
        assert (token_files.EliasFano(n, *token_files.ef_encode(v, bound)).get(np.arange(n)) == v).all()


def test_token_files(spark, docs, empty, tmp_path):
    tok = Tokenizer.from_file(WORD_BPE)
    token_files.write_token_files(docs, str(tmp_path / "a"), WORD_BPE, 1, block_ids=300)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    before = 0
    for r, (doc, text) in zip(got, sorted(rows_of(docs), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc, before, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        before += len(ids)
    token_files.write_token_files(empty, str(tmp_path / "b"), WORD_BPE, 1)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_packing(docs, empty):
    tok = Tokenizer.from_file(BYTE_BPE)
    got = packing.pack(docs, BYTE_BPE, 0, window=64).collect()
    want = Counter((d, tuple(tok.encode(t, add_special_tokens=False).ids + [0])) for d, t in rows_of(docs))
    flat = []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 64 + r.offset == len(flat) and r.offset + r.length <= 64
        flat += np.frombuffer(r.ids, "<u4").tolist()
        assert zlib.crc32(r.ids) == r.ids_crc32
    ends = Counter()
    for r in got:
        if r.start == 0:
            at = r.sequence_id * 64 + r.offset
            ends[(r.doc_id, tuple(flat[at : at + r.doc_tokens]))] += 1
    assert ends == want and packing.pack(empty, BYTE_BPE, 0).count() == 0


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(links):
    label = np.arange(len(links))
    while True:
        new = np.array([label[m].min() for m in links])
        if (new == label).all():
            return label
        label = new


def test_simhash(docs, empty):
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    rows = sorted(set(rows_of(docs)), key=lambda x: (x[0] is None, x[0] or 0))
    fps = np.array([plain_print(t) for _, t in rows], np.uint64)
    label = closure(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    assert got == {(d, int(f)): rows[i][0] for (d, _), f, i in zip(rows, fps, label)}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label)) and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_print_links_find_every_close_pair(spark, bits):
    rnd = np.random.default_rng(bits)
    base = rnd.integers(0, 2**63, 30, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 4), replace=False)) for _ in range(200)], np.uint64)
    fps = np.unique(base[rnd.integers(0, 30, 200)] ^ flips)
    names = fps.view(np.int64)
    links = simhash.print_links(spark.createDataFrame([(int(x),) for x in names], "fp long"), bits)
    found = {r.node: r.component for r in components(links).collect()}
    label = closure(np.bitwise_count(fps[:, None] ^ fps[None]) <= bits)
    for i, name in enumerate(names):
        assert found.get(int(name), int(name)) == min(int(n) for n, k in zip(names, label) if k == label[i])


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(0, i) for i in range(301, 340)] + [(7, 7), (None, 3)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    link = np.eye(461, dtype=bool)
    for u, v in edges:
        if u is not None:
            link[u, v] = link[v, u] = True
    label = closure(link)
    assert all(got.get(i, i) == label[i] for i in range(461)) and components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot", [200_000, 1])
def test_suffix_dedup(docs, empty, hot, monkeypatch):
    rows = [(d, t.encode()) for d, t in rows_of(docs)]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = Counter()
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        if gone.any():
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            want[(int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.removed(docs, hot=hot)
    keys = docs.select(*suffix_dedup.text_key())
    assert Counter((r.n_removed, r.n_spans, r.kept_sha256) for r in keys.join(got, ["_id", "_th"]).collect()) == want
    if hot > 1:
        cut = suffix_dedup.without_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count() and suffix_dedup.without_repeats(empty).count() == 0


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    say = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    part = say(700)
    docs = spark.createDataFrame([(0, say(5000) + part + say(3000)), (1, say(10) + part + say(900)), (2, say(4000))], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.removed(docs).collect()] == [(701, 1)] * 2  # the letter before is the same


def test_licenses(spark, docs, empty):
    mit = dict(licenses.TEXTS)["mit"].split()
    gap = " ".join(mit[:10] + ["indeed"] + mit[10:])
    texts = ["The MIT License, mit\nlicense", "GNU GENERAL Public-License! CC-BY cc by", f"x {gap} y", "appache licence", None, "mit éLicense ßmit license"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[:2]] == [(5, 2, 1, 3, "mit"), (8, 3, 0, 6, "cc-by,gpl")]
    assert (got[2].n_base, got[2].labels, got[2].score) == (0, "mit", 14 / 17) or got[2].labels == "mit"
    assert [(r.n_base, r.labels) for r in got[3:]] == [(0, "")] * 3
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_replies(spark):
    rows = [(1, 1, None, "user", "a \\<|im_end|>\n", 0.0), (1, 2, 1, "assistant", "[INST] b", 1.0), (1, 3, 1, "assistant", "c", 5.0), (1, 4, 3, "us\ner", None, 1.0), (1, 5, 4, "assistant", "é𝄞</s>", 9.0)]
    rows += [(2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0), (3, 1, 99, None, "orphan", None)]
    got = {r.tree: r for r in replies.conversations(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")).withColumn("back", replies.read_turns(F.col("formatted"))).collect()}
    assert set(got) == {1, 3} and got[1].leaf == 5
    assert [(t.role, t.text) for t in got[1].back] == [("user", "a \\<|im_end|>\n"), ("assistant", "c"), ("us\ner", ""), ("assistant", "é𝄞</s>")]
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss] == ["c", "é𝄞<\\/s>"]
    two = replies.branches(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), keep=2).collect()
    assert sorted((r.leaf, r.node, r.turn) for r in two if r.tree == 1) == [(2, 1, 0), (2, 2, 1), (5, 1, 0), (5, 3, 1), (5, 4, 2), (5, 5, 3)]


def test_automaton_finds_exactly_the_close_words():
    terms = ["idiot", "scum", "worthless", "trash"]
    lexicon, rnd = toxicity.Lexicon(terms), random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randrange(4)):
            p = rnd.randrange(len(w) + 1)
            w[p : p + rnd.randrange(2)] = rnd.choice(["", "a", "x1", "s"])
        word = "".join(w)
        near = [(distance(toxicity.RUN.sub(r"\1", word), t), t) for t in terms]
        near = min(((d, t) for d, t in near if d <= toxicity.edits_allowed(t)), default=None)
        assert lexicon.find(word) == (near[::-1] if near else None), word


def test_toxicity(spark, docs, empty, sf):
    table = lambda t: spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/{t}.parquet")
    model = toxicity.learn(table("documents"), table("labels"))
    got = toxicity.score(table("documents"), model).join(table("labels"), "doc_id").filter("held_out and toxic is not null").select("score", "toxic").toPandas()
    low, high = got.score[got.toxic == 0], got.score[got.toxic == 1]
    assert (low >= 0.7).mean() < 0.03 and (high >= 0.7).mean() > 0.5
    assert toxicity.reject(docs, model).columns == docs.columns and toxicity.reject(docs, model).count() == docs.count()
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(empty, nothing).count() == 0 and {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_decontamination(spark, docs, empty):
    rnd = random.Random(6)
    words = [f"w{i}é" for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(5, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, want = [], []
    for rep in range(8):
        for i, t in items[:40]:
            w = t.split()
            for _ in range(int(len(w) * 0.2 + 1e-9)):
                p = rnd.randrange(len(w))
                w[p : p + rnd.randrange(2)] = rnd.choices(words, k=rnd.randrange(2))
            texts.append(" ".join(rnd.choices(words, k=30) + w + rnd.choices(words, k=30)))
            want.append(i)
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert np.mean([(d, i) in found for d, i in enumerate(want)]) >= 0.95
    assert all(e <= 8 for e in found.values())
    assert decontamination.without_leaks(docs, bench).count() == docs.count() and decontamination.leaks(empty, bench).count() == 0


def test_embedding_dedup(spark):
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(60, 16))
    x = base[rnd.integers(0, 60, 500)] + rnd.normal(size=(500, 16)) * 0.2
    x[10] = x[3]
    rows = [(i, v.astype(np.float32).tolist(), int(i % 2) if i % 50 else None) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    v = np.array([r[1] for r in rows[:500]], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([-i if r[2] is None else r[2] + 1 for i, r in enumerate(rows[:500])])
    link = (v @ v.T >= 0.93) & (label[:, None] == label[None]) & (label[:, None] > 0)
    np.fill_diagonal(link, False)
    assert sum(got[i].n_links for i in range(500)) >= 0.95 * link.sum() and all(got[i].n_links <= link[i].sum() for i in range(500))
    assert [got[i].n_links for i in (900, 901, 902, 903, 904, 905)] == [0, 0, 0, 0, 1, 1] and got[905].component_id == 904 and not got[905].kept
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_token_counts(spark, docs, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    schema = "seq long, op string, doc_id long, version string, source string, lang string, tokens long"
    first = [(1, "insert", 1, "v1", "a", "en", 10), (1, "insert", 2, "v1", "a", None, 5), (1, "insert", None, "v1", "b", "de", None), (2, "revise", 1, "v1", "a", "en", 12)]
    second = [(1, "revise", 1, "v1", "b", "en", 7), (1, "delete", 2, "v1", None, None, None), (1, "delete", 77, "v1", None, None, None), (1, "insert", 1, "v2", "b", "en", 3)]
    assert roll.totals().count() == 0
    for batch, rows, new in ((0, first, True), (1, second, True), (1, second, False), (0, first, False)):
        assert roll.commit(batch, spark.createDataFrame(rows, schema)) is new
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert got == {("b", "en", "v1"): (1, 7), ("b", "de", "v1"): (1, 0), ("b", "en", "v2"): (1, 3)}
    tok = Tokenizer.from_file(BYTE_BPE)
    counted = token_counts.count_tokens(docs, BYTE_BPE).collect()
    assert Counter((r.doc_id, r.tokens) for r in counted) == Counter((d, len(tok.encode(t, add_special_tokens=False).ids)) for d, t in rows_of(docs))


def test_queries_with_sql(spark, sf):
    import duckdb

    from repoloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, sf).select(want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(want.fetchall()), name

"""Trees, orders, rankings, selection, documents."""

import datetime
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from repoloom.operators import ordering, outline, ranking, selection, tree
from repoloom.plans import document as doc
from repoloom.sources import checkouts, writers


def test_running_totals_on_a_hot_group(spark):
    """One group holds most rows; positions equal those of a plain sort."""
    rows = [("hot" if i % 10 else f"g{i}", (i * 7919) % 100003, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, o long, n long").repartition(7)
    got = ranking.running_totals(df, ["g"], ["o"], {"total": F.col("n")}).collect()
    expected = {}
    for g, o, n in sorted(rows):
        expected[(g, o)] = expected.get((g, "sum"), 0)
        expected[(g, "sum")] = expected.get((g, "sum"), 0) + n
    assert {(r["g"], r["o"]): r["total"] for r in got} == {k: v for k, v in expected.items() if k[1] != "sum"}
    parts = df.repartitionByRange(8, "g", "o").withColumn("p", F.spark_partition_id())
    assert parts.filter("g = 'hot'").select("p").distinct().count() > 4


def test_export_order(spark):
    paths = ["b/z.py", "a.py", "B/a.py", "b/c/x", "README.txt", "a/b.py", "readme", "Z", "b.d/x", "b/C.py"]
    df = spark.createDataFrame([("r", "m", i, p) for i, p in enumerate(paths)], "repo string, branch string, pos long, path string")
    got = [r["path"] for r in ordering.file_order(df).orderBy("file_pos").collect()]
    assert got == ["readme", "README.txt", "a.py", "Z", "a/b.py", "B/a.py", "b/C.py", "b/z.py", "b/c/x", "b.d/x"]


def test_tree_merges_case_and_shows_submodules(spark):
    items = [("Src/a.cs", "blob"), ("src/B.cs", "blob"), ("lib", "commit"), ("empty", "tree"), (" ", "blob")]
    df = spark.createDataFrame([("r", "m", i, p, t) for i, (p, t) in enumerate(items)], "repo string, branch string, pos long, path string, type string")
    projects = spark.createDataFrame([("r", "P")], "repo string, name string")
    text = tree.tree_text(tree.tree_listing(df, projects)).first()["tree_text"]
    assert text == "P/\n|-- empty/\n|-- Src/\n|   |-- a.cs\n|   \\-- B.cs\n\\-- lib"


def test_selection(spark):
    inv = spark.createDataFrame(
        [("r", "m", p, s, big) for p, s, big in [("a/x", True, False), ("a/big", True, True), ("a/bin", False, False), ("ab", True, False)]],
        "repo string, branch string, path string, selectable boolean, large boolean",
    )

    def pick(*rows):
        sel = spark.createDataFrame([("r", "m", *r) for r in rows], "repo string, branch string, prefix string, explicit boolean")
        return sorted(r["path"] for r in selection.select_files(inv, sel).collect())

    assert pick(("a", False)) == ["a/x"]
    assert pick(("a/big", True), ("a/bin", True)) == ["a/big"]
    assert pick(("a/big", False)) == []
    assert pick(("", False), ("a/big", True)) == ["a/big", "a/x", "ab"]
    assert sorted(r["path"] for r in selection.select_files(inv).collect()) == ["a/x", "ab"]


def test_unique_names(spark):
    wanted = spark.createDataFrame([("x", 1), ("X", 2), ("x", 3), ("y.zip", 4)], "name string, pos long")
    taken = spark.createDataFrame([("x",), ("x (3)",), ("y.zip",)], "name string")
    got = {r["pos"]: r["free_name"] for r in ordering.unique_package_names(wanted, taken).collect()}
    assert got == {1: "x (2)", 2: "X (4)", 3: "x (5)", 4: "y.zip (2)"}
    zipped = ordering.unique_package_names(wanted.filter("pos = 4"), taken, ".zip").first()
    assert zipped["free_name"] == "y (2).zip"


def test_unique_names_against_one_by_one(spark):
    """Names given earlier block later requests of every base name."""
    import random

    rng = random.Random(5)
    names = ["x", "x (2)", "X (3)", "x (2) (2)", "x (2) (3)", "y", "y (4)", "x (1)", "z"]
    asked = [(rng.choice(names), pos) for pos in range(60)] + [("q", 60), ("q", 61), ("q (2)", 62), ("q (3)", 63)]
    taken = ["x (4)", "y (2)"]
    used, expected = {t.upper() for t in taken}, {}
    for name, pos in asked:
        n, free = 1, name
        while free.upper() in used:
            n += 1
            free = f"{name} ({n})"
        used.add(free.upper())
        expected[pos] = free
    wanted = spark.createDataFrame(asked, "name string, pos long")
    got = ordering.unique_package_names(wanted, spark.createDataFrame([(t,) for t in taken], "name string")).collect()
    assert {r["pos"]: r["free_name"] for r in got} == expected


def test_repeated_paths_missing_bytes_and_projects(spark):
    """Repeated paths count once; files without bytes keep a reason; a repository needs no project row."""
    files = spark.createDataFrame(
        [("r", "m", 2, "a\\b.md", b"two"), ("r", "m", 1, "a/b.md", b"one"), ("r", "m", 3, "a/b.md", b"one"), ("r", "m", 4, "n.txt", None), ("r", "m", 5, "c.txt", b"12345678")],
        "repo string, branch string, pos long, path string, content binary",
    )
    items = spark.createDataFrame([], "repo string, branch string, pos long, path string, type string")
    projects = spark.createDataFrame([("other", "P", "u")], "repo string, name string, web_url string")
    stamp = datetime.datetime(2024, 5, 6, 7, 8, 9)
    made = doc.merge_corpus(files, items, projects, stamp, large_bytes=8)
    units = {r["path"]: (bytes(r["content"] or b""), r["reason"]) for r in made["units"].collect()}
    assert units == {"a/b.md": (b"one", None), "n.txt": (b"", "file without readable bytes")}
    assert {r["path"]: r["large"] for r in made["inventory"].collect()} == {"a/b.md": False, "n.txt": False, "c.txt": True}
    assert [r["error"] for r in made["headers"].collect()] == ["no project named for r"]
    text = doc.merged_document(made["blocks"]).first()["text"]
    assert text.startswith("# r\n") and text.count("### a/b.md") == 1 and "two" not in text
    picked = spark.createDataFrame([("r", "m", "", False)], "repo string, branch string, prefix string, explicit boolean")
    chosen = doc.merge_corpus(files, items, projects, stamp, picked, large_bytes=8)["units"]
    assert {r["path"]: r["reason"] for r in chosen.collect()} == {p: v[1] for p, v in units.items()}
    with pytest.raises(Exception, match="no project named for r"):
        doc.merge_corpus(files, items, projects, stamp, strict=True)["headers"].select("header").collect()


def test_overlapping_spans(spark):
    rows = [("a", 0, 50), ("a", 10, 20), ("A", 15, 30), ("b", 10, 20), ("c", 16, 18)]
    df = spark.createDataFrame([("r", "m", "p", i, *s) for i, s in enumerate(rows)], "repo string, branch string, path string, emit_pos int, name string, start int, end int")
    got = [(r["qualified_name"], r["parent_ord"], r["depth"]) for r in outline.span_parents(df).orderBy("ord").collect()]
    assert got == [("a", 0, 0), ("a.a", 1, 1), ("a.b", 1, 1), ("a.A", 1, 1), ("a.A.c", 4, 2)]


FILES = {
    "README.md": b"# hi\n",
    "src/a.py": b"import os\n\n# n\ndef f():\n    pass\ndef f():\n    return 1\n",
    "img/x 1.png": b"\x89PNG\x00",
    "doc.pdf": b"%PDF",
    "x.exe": b"MZ",
    "blob.dat": b"\x00\x01",
}


def corpus(spark):
    files = spark.createDataFrame([("r", "m/1", p, bytearray(c)) for p, c in FILES.items()], "repo string, branch string, path string, content binary")
    items = spark.createDataFrame([("r", "m/1", i, p, "blob") for i, p in enumerate(FILES)], "repo string, branch string, pos long, path string, type string")
    projects = spark.createDataFrame([("r", "My_P", "https://h/r/")], "repo string, name string, web_url string")
    return doc.merge_corpus(files, items, projects, datetime.datetime(2024, 5, 6, 7, 8, 9))


DOCUMENT = """# My\\_P

Branche du depot : [m/1](https://h/r/-/tree/m%2F1)

## 240506 070809 My\\_P \\[m\\-1\\].md

## Arborescence

~~~text
My_P/
|-- img/
|   \\-- x 1.png
|-- src/
|   \\-- a.py
|-- blob.dat
|-- doc.pdf
|-- README.md
\\-- x.exe
~~~

## Table des matieres

- [README.md](#{0})
- [doc.pdf](#{1})
- [img/x 1.png](#{2})
- [src/a.py](#{3})
  - [f](#{4})
  - [f \\(2\\)](#{5})

<a name="{0}"></a>
### README.md

~~~markdown
# hi
~~~

<a name="{1}"></a>
### doc.pdf

[doc.pdf](assets/doc.pdf)

<a name="{2}"></a>
### img/x 1.png

![x 1.png](assets/img/x%201.png)

<a name="{3}"></a>
### src/a.py

~~~python
import os
~~~

<a name="{4}"></a>
#### f

~~~python
# n
def f():
    pass
~~~

<a name="{5}"></a>
#### f \\(2\\)

~~~python
def f():
    return 1
~~~

"""


def test_document(spark, tmp_path):
    import hashlib

    def anchor(text, slug):
        return f"{slug}-{hashlib.sha256(text.encode()).hexdigest()[:8]}"

    names = [("file-README.md", "file-readme-md"), ("file-doc.pdf", "file-doc-pdf"), ("file-img/x 1.png", "file-img-x-1-png"), ("file-src/a.py", "file-src-a-py"), ("fn::src/a.py::f::11", "fn-src-a-py-f-11"), ("fn::src/a.py::f::33", "fn-src-a-py-f-33")]
    expected = DOCUMENT.format(*[anchor(t, s) for t, s in names])
    made = corpus(spark)
    whole = doc.merged_document(made["blocks"]).collect()
    assert [r["piece"] for r in whole] == [0]
    assert whole[0]["text"] == expected
    # Cut into pieces, nothing is lost.
    small = doc.merged_document(made["blocks"], piece_chars=200).orderBy("piece").collect()
    assert len(small) > 3 and "".join(r["text"] for r in small) == expected
    lines = [r["text"] for r in doc.document_lines(made["blocks"]).orderBy("line_no").collect()]
    assert "\n".join(lines) + "\n" == expected
    out = str(tmp_path / "md")
    written = writers.write_markdown(made["blocks"], made["headers"], out).collect()
    name = made["headers"].first()["file_name"]
    assert {(r["repo"], r["branch"], r["file_name"]) for r in written} == {("r", "m/1", name)}
    parts = [r["part"] for r in sorted(written, key=lambda r: r["part_no"])]
    stored = "".join(open(unquote(p.removeprefix("file:")), encoding="utf-8").read() for p in parts)
    assert stored == expected
    back = writers.read_markdown(spark, out).orderBy("line_no").collect()
    assert "".join(r["text"] + "\n" for r in back) == expected and [r["line_no"] for r in back] == list(range(1, len(back) + 1))
    with pytest.raises(ValueError, match="already"):
        writers.write_markdown(made["blocks"], made["headers"], out)
    assert {r["asset_path"] for r in made["assets"].collect()} == {"assets/doc.pdf", "assets/img/x 1.png"}


def test_segments_give_the_text_back(spark, sf):
    from repoloom.plans import functions as fn
    from workload import queries as q

    df = outline.with_segments(outline.with_outline(fn.with_spans(q.code_units(spark, sf))))
    joined = F.array_join(
        F.transform(F.filter("segments", lambda s: s["kind"] != "heading"), lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])), ""
    )
    assert df.filter(joined != F.col("text")).count() == 0


def test_checkouts(spark, tmp_path):
    for repo, path, data in [("r1", "a/b.txt", b"xy"), ("r2", "c.bin", b"\x00")]:
        target = tmp_path / "co" / repo / "main" / path
        target.parent.mkdir(parents=True)
        target.write_bytes(data)
    (tmp_path / "co" / "stray.txt").write_bytes(b"z")
    rows = checkouts.read_checkouts(spark, str(tmp_path / "co")).orderBy("repo").collect()
    assert [(r["repo"], r["branch"], r["path"], bytes(r["content"]), r["size"], r["error"]) for r in rows] == [
        (None, None, "stray.txt", b"z", 1, "outside of the layout"),
        ("r1", "main", "a/b.txt", b"xy", 2, None),
        ("r2", "main", "c.bin", b"\x00", 1, None),
    ]
    with pytest.raises(Exception, match="stray.txt"):
        checkouts.read_checkouts(spark, str(tmp_path / "co"), strict=True).select("error").collect()


def test_documents_of_one_name_and_a_broken_attempt(spark, tmp_path):
    blocks = [(repo, branch, 0, str(k).zfill(4), "", f"{repo} {branch} line {k}\n\n") for repo, branch in (("007", "a"), ("7", "a"), ("x/y", "b=1")) for k in range(300)]
    blocks = spark.createDataFrame(blocks, "repo string, branch string, part int, key string, path string, text string")
    headers = spark.createDataFrame([("007", "a", "Same.md"), ("7", "a", "same.md"), ("x/y", "b=1", "other.md")], "repo string, branch string, file_name string")
    out = str(tmp_path / "md")
    (tmp_path / "md" / "parts-0" / "repo=7" / "branch=a").mkdir(parents=True)
    (tmp_path / "md" / "parts-0" / "repo=7" / "branch=a" / "part-00000-left.txt").write_text("left over\n")
    assert not writers.is_committed(spark, out)
    with pytest.raises(ValueError, match="no complete"):
        writers.read_markdown(spark, out)
    taken = spark.createDataFrame([("Other",)], "name string")
    names = writers.write_markdown(blocks, headers, out, taken).select("repo", "package", "file_name").distinct().collect()
    assert {tuple(r) for r in names} == {("007", "Same", "Same.md"), ("7", "same (2)", "same (2).md"), ("x/y", "other (2)", "other (2).md")}
    lines = {}
    for r in writers.read_markdown(spark, out).orderBy("repo", "line_no").collect():
        lines.setdefault((r["repo"], r["branch"]), []).append(r["text"])
    assert lines == {(repo, b): [t for k in range(300) for t in (f"{repo} {b} line {k}", "")] for repo, b in (("007", "a"), ("7", "a"), ("x/y", "b=1"))}


def test_response_charsets(spark):
    from repoloom.sources.responses import file_text

    rows = [("cp1252", b"\x80\xe9", "\u20ac\xe9"), ("Latin1", b"\xe9", "\xe9"), ("iso-8859-15", b"\xa4", "\u20ac"), ("US-ASCII", b"a\xe9", "a\ufffd")]
    rows += [("utf-32", b"a\0\0\0", "a"), ("utf-16be", b"\0a", "a"), ("unicode", b"a\0", "a"), ("utf8", b"\xff", "\ufffd"), ("none", b"\xc3\xa9", "\xe9"), (None, b"\xc3\xa9", "\xe9"), ("cp1252", None, None)]
    df = spark.createDataFrame(rows, "charset string, content binary, want string")
    got = df.select("charset", "want", file_text(F.col("content"), F.col("charset")).alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []

"""Listing, reading and writing of checkouts; inventories that leave the bytes unread; selections; cut trees."""

import os
import random

import pytest
from pyspark.sql import functions as F

from repoloom.operators import classify, selection, tree
from repoloom.sources import listing

FILES = {
    "r1/main/a/__init__.py": b"",
    "r1/main/a/b.py": b"x = 1\n",
    "r1/main/.gitignore": b"*.o\n",
    "r1/main/.github/w.yml": b"on: push\n",
    "r1/main/.git/HEAD": b"ref: refs/heads/main\n",
    "r1/main/data.gz": b"not compressed",
    "r1/main/deep/1/2/3/4/5/6/x.foo": b"text" * 3000,
    "r2/v 1%20/é=1/_x.bin2": b"\x00" * 10,
    "r2/v 1%20/back\\slash.md": b"# t",
    "stray.txt": b"z",
}


@pytest.fixture
def home(tmp_path):
    for name, data in FILES.items():
        target = tmp_path / "co" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(tmp_path / "co", tmp_path / "co" / "r1" / "main" / "loop")
    return str(tmp_path / "co")


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_every_file_is_listed_and_read(spark, home, scheme):
    files = listing.list_checkouts(spark, scheme + home)
    got = {r["address"]: r for r in listing.with_content(files, scheme + home).collect()}
    assert set(got) == {k for k in FILES if "/.git/" not in k} | {"r1/main/loop"}
    for name, r in got.items():
        if name == "r1/main/loop":
            assert (r["error"], r["size"], r["content"]) == ("symbolic link", None, None)
            continue
        assert (bytes(r["content"]), r["size"]) == (FILES[name], len(FILES[name]))
        if name == "stray.txt":
            assert (r["repo"], r["branch"], r["path"], r["error"]) == (None, None, name, "outside of the layout")
        else:
            assert ("/".join((r["repo"], r["branch"], r["path"])), r["error"]) == (name, None)
    with pytest.raises(Exception, match="stray.txt"):
        listing.list_checkouts(spark, scheme + home, strict=True).select("error").collect()


def test_files_that_went_away_and_wrong_roots(spark, home, tmp_path):
    files = listing.list_checkouts(spark, home).filter("path = 'a/b.py'")
    os.remove(f"{home}/r1/main/a/b.py")
    row = listing.with_content(files, home).first()
    assert row["content"] is None and row["error"] == "file not readable: FileNotFoundError"
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no file system"):
        listing.list_files(spark, "viewfs://x/y")
    (tmp_path / "empty").mkdir()
    assert listing.with_content(listing.list_checkouts(spark, str(tmp_path / "empty")), str(tmp_path / "empty")).collect() == []


def test_batches_are_cut_by_bytes(spark, home, monkeypatch):
    monkeypatch.setattr(listing, "BYTES_A_BATCH", 10)
    files = listing.list_checkouts(spark, home).filter("error is null").coalesce(1)
    got = {r["address"]: bytes(r["content"]) for r in listing.with_content(files, home).collect()}
    assert got == {k: v for k, v in FILES.items() if "/.git/" not in k and k != "stray.txt"}


def test_inventory_of_checkouts_opens_unknown_types_only(spark, home):
    inv = {r["path"]: r for r in listing.checkout_inventory(spark, home, skip=(".git", "r2")).collect()}
    assert {p: (r["class"], r["selectable"], r["size"]) for p, r in inv.items()} == {
        "a/__init__.py": ("text", True, 0), "a/b.py": ("text", True, 6), ".gitignore": ("text", True, 4), ".github/w.yml": ("text", True, 9),
        "data.gz": ("binary", False, 14), "deep/1/2/3/4/5/6/x.foo": ("unknown", True, 12000),
    }
    asked = listing.list_checkouts(spark, home).filter("error is null")
    heads = {r["path"]: r["head"] for r in listing.with_head(asked, home, F.col("path").endswith(".foo")).collect()}
    assert [p for p, h in heads.items() if h is not None] == ["deep/1/2/3/4/5/6/x.foo"] and len(heads["deep/1/2/3/4/5/6/x.foo"]) == 4096
    unknown = {r["path"]: (r["class"], r["selectable"]) for r in listing.checkout_inventory(spark, home, skip=("r1",)).collect()}
    assert unknown == {"é=1/_x.bin2": ("unknown", False), "back\\slash.md": ("text", True)}


def test_written_checkouts_come_back(spark, tmp_path):
    rows = [("r", "m", "a/b.gz", b"1"), ("r", "m", ".e", b""), ("r", "m", "../../x", b"2"), ("r", "m", "/abs", b"3"), ("r/s", "m", "c", b"4")]
    rows += [("r", "m", "gone", None), (None, "m", "d", b"5"), ("r", "..", "d", b"6"), ("r", "m", None, b"7"), ("r", "m", "a//c", b"8")]
    files = spark.createDataFrame(rows, "repo string, branch string, path string, content binary").withColumn("address", F.lit("clash"))
    out = str(tmp_path / "out")
    os.mkdir(out)
    made = listing.write_checkouts(files, out).collect()
    assert sorted(r["error"] for r in made if r["error"]) == ["no bytes"] + ["no place below the root"] * 7
    back = listing.with_content(listing.list_checkouts(spark, out), out).collect()
    assert {(r["path"], bytes(r["content"])) for r in back} == {("a/b.gz", b"1"), (".e", b"")}
    assert os.listdir(tmp_path) == ["out"]


def test_packed_tables_are_inventoried_without_content(spark, tmp_path):
    rows = [("r", "m", "a.py", b"x", 7), ("r", "m", "b.foo", b"t" * 5000, None), ("r", "m", "c.foo", b"\x00", 1), ("r", "m", "d.foo", None, 9), ("r", "m", "e.py", None, 3), ("r", "m", "f.foo", b"", 0)]
    files = spark.createDataFrame(rows, "repo string, branch string, path string, content binary, size long")
    classify.packed(files).write.parquet(str(tmp_path / "p"))
    inv = classify.inventory(spark.read.parquet(str(tmp_path / "p")), large_bytes=4000)
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan
    got = {r["path"]: (r["selectable"], r["size"], r["error"], r["large"]) for r in inv.collect()}
    assert got == {
        "a.py": (True, 1, None, False), "b.foo": (True, 5000, None, True), "c.foo": (False, 1, None, False),
        "d.foo": (False, None, "bytes not readable", False), "e.py": (True, 3, None, False), "f.foo": (True, 0, None, False),
    }
    whole = classify.inventory(files.drop("size"), large_bytes=4000).collect()
    assert {r["path"]: r["selectable"] for r in whole} == {p: v[0] for p, v in got.items()}


def test_selection_equals_brute_force_and_sniffs_once(spark):
    rng = random.Random(5)
    names = ["a", "b", "a.b", "a0", "a-", "é", "a\0", " "]
    paths = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    rows = [("hot" if i % 10 else f"r{i % 3}", "m", p, i % 7 != 0, i % 5 == 0) for i, p in enumerate(paths)] + [(None, "m", "a", True, False)]
    wanted = [("hot", "m", rng.choice(paths).rsplit("/", 1)[0], i % 2 == 0) for i in range(40)]
    wanted += [("hot", "m", rng.choice(paths) + "/", i % 2 == 0) for i in range(200)] + [("r1", "m", "", False), ("r2", "m", "/", True), ("hot", "m", None, True), (None, "m", "", True)]
    tries = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def sniffed(flag):
        tries.add(1)
        return flag

    inv = spark.createDataFrame(rows, "repo string, branch string, path string, selectable boolean, large boolean").repartition(4)
    chosen = selection.select_files(inv.withColumn("selectable", sniffed("selectable")), spark.createDataFrame(wanted, "repo string, branch string, prefix string, explicit boolean"))
    got = sorted((r["repo"], r["path"], r["large"]) for r in chosen.collect())
    assert tries.value == len(rows) and chosen.columns == inv.columns
    plain = {}
    for repo, _, prefix, explicit in wanted:
        if repo is not None and prefix is not None:
            plain.setdefault(repo, {}).setdefault(prefix.rstrip("/"), []).append(explicit)

    def takes(repo, path, large):
        offers = plain.get(repo, {})
        if large:
            return any(offers.get(path, []))
        return path in offers or "" in offers or any(path[:i] in offers for i, c in enumerate(path) if c == "/")

    assert got == sorted((r, p, big) for r, _, p, ok, big in rows if ok and r is not None and takes(r, p, big)) and len(got) > 100
    assert selection.select_files(inv.limit(0), spark.createDataFrame(wanted, "repo string, branch string, prefix string, explicit boolean")).collect() == []


def test_trees_are_cut_between_lines(spark):
    items = [("r", "m", i, f"d{i % 40}/f{i} ", "blob") for i in range(900)] + [("s", "m", 0, "x", "blob")]
    df = spark.createDataFrame(items, "repo string, branch string, pos long, path string, type string")
    lines = tree.tree_listing(df, spark.createDataFrame([("r", "P")], "repo string, name string"))
    whole = {r["repo"]: r["tree_text"] for r in tree.tree_text(lines).collect()}
    pieces = tree.tree_text(lines, piece_chars=500).orderBy("repo", "piece").collect()
    joined = {}
    for r in pieces:
        joined[r["repo"]] = joined.get(r["repo"], "") + r["tree_text"]
    assert joined == whole and len(pieces) > 20 and max(len(r["tree_text"]) for r in pieces) < 600
    rows = sorted((r["line_key"].encode(), r["line"]) for r in lines.filter("repo = 'r'").collect())
    assert whole["r"] == "\n".join(line for _, line in rows).rstrip() and whole["s"] == "s/\n\\-- x"


def test_tasks_of_a_level_are_bounded(spark, tmp_path, monkeypatch):
    """Tables of a level have a bounded number of files, and a shuffle between two levels a bounded number of blocks."""
    cores = spark.sparkContext.defaultParallelism
    names = {f"r/m/{i}/d/f.py" for i in range(6 * cores)}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"x")
    monkeypatch.setattr(listing, "FOLDERS_A_TASK", 1)
    tasks, pinned = [], listing.pinned
    monkeypatch.setattr(listing, "pinned", lambda df: tasks.append(df.rdd.getNumPartitions()) or pinned(df))
    assert {r["address"] for r in listing.list_files(spark, str(tmp_path)).collect()} == names
    assert len(tasks) == 5 and max(tasks) == 4 * cores

"""List, read and write checkouts in tasks: every file counts, and the driver holds no list of files.

Spark's own file source keeps the status of each file in the driver and passes over empty files and over names that
start with `.` or `_` (`.gitignore`, `__init__.py`). Here tasks list the folders level by level through Arrow's file
systems (local, hdfs, s3, gs, abfs), and files are opened where they are wanted: not at all, their first bytes, or whole.
"""

from __future__ import annotations

import math
import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions.lookups import SNIFF_BYTES
from repoloom.session import pinned
from repoloom.sources.checkouts import LAYOUT, by_layout

# Names that are no part of a checkout's files.
SKIP = (".git",)
FOLDERS_A_TASK = 200
# Tasks of a level for each core. A task streams its rows, so its memory doesn't grow with its folders; with tasks in proportion
# to the folders, the tables' files would grow as the input and the blocks of a shuffle between two levels as its square.
WAVES = 4
BYTES_A_TASK = 128 << 20
BYTES_A_BATCH = 16 << 20
# A cell holds less than 2^31 bytes.
MOST_BYTES = (1 << 31) - (1 << 20)

ENTRY = "address string, size long, is_folder boolean, problem string"
GONE = (PermissionError, FileNotFoundError, NotADirectoryError)


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for `root` and the path of `root` in it."""
    scheme, _, rest = root.partition(":")
    try:
        if scheme == "file":  # Hadoop writes file:/a, Arrow wants file:///a; names are not escaped
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/").rstrip("/")
        store, home = pafs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, OSError) as e:  # a scheme that Arrow doesn't know, or one whose library isn't there
        raise ValueError(f"Arrow opens no file system for {root}; read_checkouts reads what Spark reads") from e
    return store, home.rstrip("/")


def _entries(store: pafs.FileSystem, home: str, folder: str, skip: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of one folder. Links are not followed, so a loop of links ends."""
    try:
        infos = store.get_file_info(pafs.FileSelector(f"{home}/{folder}" if folder else home))
    except GONE as e:
        yield folder, None, False, f"folder not readable: {type(e).__name__}"
        return
    local = store.type_name == "local"
    for info in infos:
        if info.base_name in skip:
            continue
        address = f"{folder}/{info.base_name}" if folder else info.base_name
        if local and os.path.islink(info.path):
            yield address, None, False, "symbolic link"
        elif info.type == pafs.FileType.Directory:
            yield address, None, True, None
        elif info.type == pafs.FileType.File:
            yield address, info.size, False, None
        else:
            yield address, None, False, "neither file nor folder"


def list_files(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """`(address, size, problem)` of every file below `root`, in no order.

    The folders of a level are dealt out to tasks by number, whatever repository they belong to, so a repository that
    holds a third of them is spread; what a level holds is a table in the checkpoint folder, and the driver learns only
    the number of folders of the next. One job per level of depth, of at most WAVES tasks a core. A folder is listed by one task, with its entries in
    memory. A missing root fails; folders that can't be read, links and special files are rows with a `problem`.
    """
    store, home = open_store(root)
    if store.get_file_info(home).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")

    def lister(batches):
        store, home = open_store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_entries(store, home, folder, skip))
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000], strict=True))
                    types = (pa.string(), pa.int64(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["address", "size", "is_folder", "problem"])

    cores = spark.sparkContext.defaultParallelism
    level, n_folders, found = spark.createDataFrame([("",)], "address string"), 1, None
    while n_folders:
        tasks = min(n_folders, max(cores, min(WAVES * cores, math.ceil(n_folders / FOLDERS_A_TASK))))
        entries = pinned(level.repartition(tasks).mapInArrow(lister, ENTRY))
        files = entries.filter("not is_folder").drop("is_folder")
        found = files if found is None else found.unionByName(files)
        level = entries.filter("is_folder").select("address")
        n_folders = level.count()
    return found


def list_checkouts(spark: SparkSession, root: str, layout: str = LAYOUT, strict: bool = False, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """`(repo, branch, path, size, error, address)` of every file below `root`; no file is opened.

    `layout` and `strict` as in `read_checkouts`. A folder that couldn't be listed, a link or a special file keeps a row
    with an error, and no size.
    """
    place = by_layout(F.col("address"), layout, strict)
    error = F.coalesce("problem", place["error"])
    return list_files(spark, root, skip).select(
        place["repo"].alias("repo"), place["branch"].alias("branch"), place["path"].alias("path"), "size", error.alias("error"), "address"
    )


def _with_bytes(listing: DataFrame, root: str, name: str, limit: int | None, wanted: Column | None) -> DataFrame:
    """Add `name`: the first `limit` bytes (all without a limit) of the files that are wanted and have a size.

    Files are dealt out so that a task has about BYTES_A_TASK to read, and leave it in batches of bounded bytes.
    """
    spark = listing.sparkSession
    per_file = F.col("size") if limit is None else F.least("size", F.lit(limit))
    asked = listing.withColumn("_read", F.coalesce(F.col("size").isNotNull() & (F.lit(True) if wanted is None else wanted), F.lit(False)))
    # A file costs a request, so it counts as 64 KB at least.
    total = asked.filter("_read").agg(F.sum(F.greatest(per_file, F.lit(1 << 16)))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / BYTES_A_TASK))
    schema = listing.withColumns({name: F.lit(None).cast("binary"), "_problem": F.lit(None).cast("string")}).schema
    kept = listing.columns

    def fetch(store, path: str, size: int) -> tuple[bytes | None, str | None]:
        if limit is None and size > MOST_BYTES:
            return None, "too large for a cell"
        try:
            with store.open_input_file(path) as f:
                return (f.read() if limit is None else f.read(limit)), None
        except GONE as e:
            return None, f"file not readable: {type(e).__name__}"

    def reader(batches):
        store, home = open_store(root)
        for batch in batches:
            addresses, sizes = batch.column("address").to_pylist(), batch.column("size").to_pylist()
            flags = batch.column("_read").to_pylist()
            rows = batch.select(kept)
            start, held, got = 0, 0, []
            for i, (address, size, flag) in enumerate(zip(addresses, sizes, flags, strict=True)):
                got.append(fetch(store, f"{home}/{address}", size) if flag else (None, None))
                held += len(got[-1][0] or b"")
                if held >= BYTES_A_BATCH or i + 1 == len(addresses):
                    data, problems = zip(*got, strict=True)
                    more = [pa.array(data, pa.binary()), pa.array(problems, pa.string())]
                    part = rows.slice(start, len(got))
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*kept, name, "_problem"])
                    start, held, got = i + 1, 0, []

    filled = asked.repartition(tasks).mapInArrow(reader, schema)
    if "error" in kept:
        filled = filled.withColumn("error", F.coalesce("error", "_problem"))
    return filled.drop("_problem")


def with_content(listing: DataFrame, root: str) -> DataFrame:
    """Add `content`, the whole bytes of listed files; null with an error where they can't be read or fill no cell."""
    return _with_bytes(listing, root, "content", None, None)


def with_head(listing: DataFrame, root: str, wanted: Column | None = None) -> DataFrame:
    """Add `head`, the bytes that a sniff looks at, of the files that are `wanted` (all by default)."""
    return _with_bytes(listing, root, "head", SNIFF_BYTES, wanted)


def checkout_inventory(spark: SparkSession, root: str, **options) -> DataFrame:
    """`inventory` of the checkouts below `root`: only files of unknown type are opened, for their first bytes.

    Options are those of `list_checkouts`. Files outside of the layout and what is no readable file take no part.
    """
    from repoloom.operators.classify import inventory, with_classes

    listing = list_checkouts(spark, root, **options).filter("error is null").drop("error")
    unknown = with_classes(listing).select(*listing.columns, "is_unknown")
    return inventory(with_head(unknown, root, F.col("is_unknown")).drop("is_unknown", "address"))


def write_checkouts(files: DataFrame, root: str) -> DataFrame:
    """Write `(repo, branch, path, content)` as files `root/repo/branch/path`; returns `(address, size, error)`, stored.

    Tasks write the files; a task that runs again writes the same bytes to the same name. A place of its own for each
    file is the caller's duty. Null content, a null or blank name, and a path that leaves its folder (`..`, a leading `/`, an empty part)
    write nothing and give an error.
    """

    def writer(batches):
        store, home = open_store(root)
        made = set()
        for batch in batches:
            out = []
            for repo, branch, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [repo or "", branch or "", *(path or "").split("/")]
                address = "/".join(parts)
                plain = "/" not in parts[0] + parts[1] and all(p.strip() and p not in (".", "..") and "\0" not in p for p in parts)
                if content is None or not plain:
                    out.append((address, None, "no bytes" if plain else "no place below the root"))
                    continue
                folder = posixpath.dirname(f"{home}/{address}")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                # Without this, Arrow compresses what has a name like x.gz.
                with store.open_output_stream(f"{home}/{address}", compression=None) as f:
                    f.write(content)
                out.append((address, len(content), None))
            if out:
                columns = zip(*out, strict=True)
                types = (pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["address", "size", "error"])

    return pinned(files.select("repo", "branch", "path", "content").mapInArrow(writer, "address string, size long, error string"))

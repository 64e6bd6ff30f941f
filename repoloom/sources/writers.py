"""Write documents and assets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.operators.ordering import unique_package_names
from repoloom.operators.ranking import positions
from repoloom.session import pinned

MANIFEST = "_manifest"
SUFFIX = ".md"


def document_names(headers: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """`(repo, branch, package, file_name)`: a name of its own for each document and for the folder it lies in.

    `headers` is the output of `doc_headers`; equal names get ` (2)`, ` (3)` ... in order of repository and branch,
    skipping those in `taken(name)`, which are folders that exist already.
    """
    spark = headers.sparkSession
    asked = headers.select("repo", "branch", F.expr(f"left(file_name, length(file_name) - {len(SUFFIX)})").alias("name"))
    numbered = pinned(positions(asked.withColumn("all", F.lit(1)), ["all"], ["repo", "branch"], "pos").drop("all"))
    free = unique_package_names(numbered.select("name", "pos"), taken if taken is not None else spark.createDataFrame([], "name string"))
    named = numbered.join(free.select("pos", F.col("free_name").alias("package")), "pos")
    return named.select("repo", "branch", "package", F.concat("package", F.lit(SUFFIX)).alias("file_name"))


def write_markdown(blocks: DataFrame, headers: DataFrame, out_dir: str, taken: DataFrame | None = None) -> DataFrame:
    """Write documents as UTF-8 text and, last of all, the manifest that names them; returns the manifest.

    A document is a folder of part files, because Spark tasks write files of their own. Blocks are range-partitioned by
    their place, so a large document is written by many tasks and its parts, in order of their number, give it from
    start to end. The manifest `(repo, branch, package, file_name, part_no, part, bytes)` has a row per part.

    Nothing counts until the manifest is complete: parts lie in a folder of this attempt, an attempt that breaks off leaves
    no manifest, and a further one doesn't see its files. A folder that has a manifest isn't written again.
    """
    spark = blocks.sparkSession
    if is_committed(spark, out_dir):
        raise ValueError(f"{out_dir} holds documents already")
    attempt = f"{out_dir}/parts-{uuid.uuid4().hex}"
    order = ["repo", "branch", "part", "key", "path"]
    names = pinned(document_names(headers, taken))
    (
        pinned(blocks)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("repo", "branch", F.expr("left(text, length(text) - 1)").alias("value"))
        .write.partitionBy("repo", "branch")
        .text(attempt)
    )
    place = "_metadata.file_path"
    typed = "path string, modificationTime timestamp, length long, content binary, repo string, branch string"  # names are text, not numbers
    found = spark.read.schema(typed).format("binaryFile").load(attempt)  # names and sizes, no bytes
    parts = found.select("repo", "branch", F.col(place).alias("part"), F.col("length").alias("bytes"), F.regexp_extract(place, r"/part-([0-9]+)-[^/]*\z", 1).cast("int").alias("part_no"))
    key = [F.col(f"p.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("repo", "branch")]
    listed = parts.alias("p").join(names.alias("n"), key)
    listed.select("n.repo", "n.branch", "package", "file_name", "part_no", "part", "bytes").write.mode("overwrite").parquet(f"{out_dir}/{MANIFEST}")
    return read_manifest(spark, out_dir)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_committed(spark: SparkSession, out_dir: str) -> bool:
    return _exists(spark, f"{out_dir}/{MANIFEST}/_SUCCESS")


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    if not is_committed(spark, out_dir):
        raise ValueError(f"{out_dir} holds no complete set of documents")
    return spark.read.parquet(f"{out_dir}/{MANIFEST}")


def read_markdown(spark: SparkSession, out_dir: str) -> DataFrame:
    """Lines of the documents that the manifest names: `(repo, branch, package, file_name, line_no, text)`, counted from 1.

    Lines are read in splits; a line's place is its part, the split's offset and its turn in the split.
    """
    manifest = read_manifest(spark, out_dir)
    files = [r["home"] for r in manifest.select(F.regexp_extract("part", r"\A(.*/parts-[0-9a-f]+)/", 1).alias("home")).distinct().collect()]
    schema = "repo string, branch string, package string, file_name string, line_no bigint, text string"
    if not files:  # no document
        return spark.createDataFrame([], schema)
    lines = spark.read.option("recursiveFileLookup", "true").text(files).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("turn")
    )
    lines = lines.join(manifest.drop("bytes"), "part")
    placed = positions(pinned(lines).drop("part"), ["repo", "branch"], ["part_no", "split", "turn"], "line_no")
    return placed.select("repo", "branch", "package", "file_name", "line_no", "text")


def write_assets(assets: DataFrame, out_dir: str) -> None:
    """Asset bytes with their places as Parquet."""
    assets.write.mode("errorifexists").parquet(out_dir)

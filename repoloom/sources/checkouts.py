"""Read stored checkouts: folders of files, one folder per repository and branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default layout below the root: repository / branch / path.
LAYOUT = r"([^/]+)/([^/]+)/(.+)"


def by_layout(below: Column, layout: str = LAYOUT, strict: bool = False) -> dict[str, Column]:
    """`repo`, `branch`, `path` and `error` of an address below the root.

    A file that lies elsewhere has neither repository nor branch, its address as path, and an error; with `strict` it
    fails the job.
    """
    pattern = rf"(?s)\A{layout}\z"
    inside = below.rlike(pattern)
    repo, branch, path = (F.when(inside, F.regexp_extract(below, pattern, n)) for n in (1, 2, 3))
    message = F.concat(F.lit("file outside of the layout: "), below)
    error = F.when(~inside, F.raise_error(message) if strict else F.lit("outside of the layout"))
    return {"repo": repo, "branch": branch, "path": F.coalesce(path, below), "error": error}


def read_checkouts(spark: SparkSession, root: str, layout: str = LAYOUT, strict: bool = False) -> DataFrame:
    """Files `(repo, branch, path, content, size, error)` below `root`, by Spark's own file source.

    `layout` is a pattern with three groups for repository, branch and path, matched
    against the part of the address below `root` (`by_layout`). Size needs no content, so a plan that
    does not use `content` never reads the bytes. Spark lists the folders, in a job of its own where they are many, keeps
    the list in the driver, and leaves out empty files and names that start with `.` or `_`. `listing.list_checkouts`
    has none of these limits; this one reads every store that Spark reads.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    home = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    address = F.ltrim(F.regexp_replace("path", r"\A[a-z0-9]+:", ""), F.lit("/"))
    below = F.substring(address, F.length(home) + 2, F.length(address))
    place = by_layout(below, layout, strict)
    return raw.select(
        place["repo"].alias("repo"),
        place["branch"].alias("branch"),
        place["path"].alias("path"),
        "content",
        F.col("length").alias("size"),
        place["error"].alias("error"),
    )

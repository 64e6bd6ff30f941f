"""Order files for reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.functions.paths import export_sort_key, normalize_path
from repoloom.functions.text import is_blank
from repoloom.operators.ranking import positions, running_totals
from repoloom.session import pinned

KEYS = ["repo", "branch", "path"]


def distinct_paths(files: DataFrame) -> DataFrame:
    """Normalised, not blank paths, each once with its first position."""
    return (
        files.filter(~is_blank(F.col("path")))
        .withColumn("path", normalize_path(F.col("path")))
        .groupBy(*KEYS)
        .agg(F.min("pos").alias("pos"))
    )


def order_export_files(files: DataFrame) -> DataFrame:
    """Add `sort_key`; ordering by (sort_key, pos) is the export order of a repository."""
    return distinct_paths(files).withColumn("sort_key", export_sort_key(F.col("path")))


def file_order(files: DataFrame) -> DataFrame:
    """Add `file_pos`, the place of each file in its repository's export, from 1."""
    ordered = order_export_files(files)
    return positions(ordered, ["repo", "branch"], ["sort_key", "pos", "path"], "file_pos")


def sort_tree_items(items: DataFrame) -> DataFrame:
    """Tree items by path ignoring case, ties in input order; positions from 1."""
    kept = items.filter(~is_blank(F.col("path"))).withColumn("path_key", F.upper("path"))
    return positions(kept, ["repo", "branch"], ["path_key", "pos"], "item_pos").drop("path_key")


NUMBERED = r"(?s)\A(.*) \(([1-9][0-9]{0,17})\)\z"


def _next_free(requests: DataFrame, blocked: DataFrame) -> DataFrame:
    """Add `number` and `free_stem`: the n-th request of a stem gets its n-th number that is not blocked."""
    # k is the i-th blocked number of its stem: k - i free numbers lie below it.
    marks = positions(blocked, ["stem_key"], ["k"], "i").withColumn("free_below", F.col("k") - F.col("i"))
    # The n-th request gets n plus the count of blocked numbers with free_below < n.
    steps = (
        requests.withColumns({"at": F.col("nth"), "is_request": F.lit(1)})
        .unionByName(
            marks.select("stem_key", (F.col("free_below") + 1).alias("at"), F.lit(0).alias("is_request")),
            allowMissingColumns=True,
        )
        .withColumn("tie", F.coalesce("pos", F.lit(0).cast("bigint")))
    )
    counted = running_totals(steps, ["stem_key"], ["at", "is_request", "tie"], {"skipped": 1 - F.col("is_request")})
    number = F.col("at") + F.col("skipped")
    named = F.when(number == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" ("), number.cast("string"), F.lit(")")))
    return counted.filter("is_request = 1").select(
        "name", "stem", "stem_key", "root", "pos", "nth", number.alias("number"), named.alias("free_stem")
    )


def unique_package_names(wanted: DataFrame, taken: DataFrame, suffix: str = "") -> DataFrame:
    """Give each wanted name a free one: `x`, `x (2)`, `x (3)` ... skipping taken names.

    `wanted(name, pos)` asks in order of `pos`, which no two requests share; `taken(name)`
    exists already, and a name once given counts as taken for all later requests. `suffix`
    is an extension kept at the end, such as `.zip`. Names compare ignoring case.

    Requests of one stem are numbered at once. Two stems can meet in one name only (`x`
    with number 2 and `x (2)` with number 1); then the later request's stem loses that
    number and the names that differ by numbers alone are dealt again, until none clash.
    A round settles every clash that no earlier clash of those names can move.
    """
    size = len(suffix)
    stem = F.expr(f"left(name, length(name) - {size})") if suffix else F.col("name")
    asked = wanted.withColumn("stem", stem).withColumns(
        {"stem_key": F.upper("stem"), "root": F.upper(F.regexp_replace("stem", r"(?: \([1-9][0-9]{0,17}\))+\z", ""))}
    )
    requests = positions(asked, ["stem_key"], ["pos"], "nth")
    # A taken name blocks number 1 of its own stem, and number k of the stem before ` (k)`.
    own = taken.select(F.upper(stem).alias("stem_key"), F.lit(1).cast("bigint").alias("k"))
    numbered = taken.withColumn("stem", stem).select(
        F.upper(F.regexp_extract("stem", NUMBERED, 1)).alias("stem_key"),
        F.expr(f"try_cast(regexp_extract(stem, r'{NUMBERED}', 2) AS bigint)").alias("k"),
    )
    blocked = own.unionByName(numbered.filter("k >= 2")).distinct()
    settled = []
    while True:
        dealt = pinned(_next_free(requests, blocked))
        by_pos = F.struct("pos", "stem_key")
        clash = (
            dealt.groupBy("root", F.upper("free_stem").alias("free_key"))
            .agg(
                F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("second"),
                F.max_by("stem_key", by_pos).alias("stem_key"), F.max_by("number", by_pos).alias("k"),
            )
            .filter("n > 1")
        )
        clash = pinned(clash)
        if clash.isEmpty():
            settled.append(dealt)
            break
        roots = clash.groupBy("root").agg(F.min("second").alias("bad"))
        lost = clash.join(roots, "root").filter("first <= bad").select("stem_key", "k")
        settled.append(dealt.join(roots, "root", "left_anti"))
        requests = dealt.join(roots, "root", "left_semi").drop("number", "free_stem")
        blocked = pinned(blocked.unionByName(lost).distinct())
    named = reduce(DataFrame.unionByName, settled)
    return named.select("name", "pos", F.concat("free_stem", F.lit(suffix)).alias("free_name"))

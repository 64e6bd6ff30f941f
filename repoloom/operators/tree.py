"""Repository trees: nodes merged from paths, and their text listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.paths import FIRST, LEVEL_END, SECOND, normalize_path, path_parts
from repoloom.functions.text import is_blank, trim_end
from repoloom.operators.ranking import running_totals
from repoloom.session import pinned

# Connectors and indents of the listing.
BRANCH, LAST = "|-- ", "\\-- "
RULE, SPACE = "|   ", "    "


def tree_nodes(items: DataFrame) -> DataFrame:
    """One node per directory and leaf: name, parent, whether it is a directory, depth.

    `items(repo, branch, pos, path, type)`. Paths merge ignoring case; the name comes
    from the first item in (path ignoring case, pos) order; a node is a directory when
    something lies below it or an item of type `tree` names it. Pre-aggregation on the
    map side keeps hot directories from moving more than one row per task.
    """
    parts = path_parts(normalize_path(F.col("path")))
    offers = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda n: F.struct(
            F.array_join(F.transform(F.slice("parts", F.lit(1), n), F.upper), "/").alias("node_key"),
            F.array_join(F.transform(F.slice("parts", F.lit(1), n - 1), F.upper), "/").alias("parent_key"),
            F.get("parts", n - 1).alias("part"),
            n.alias("depth"),
            ((n < F.size("parts")) | F.col("is_tree")).alias("dir"),
        ),
    )
    exploded = (
        items.filter(~is_blank(F.col("path")))
        .select(
            "repo",
            "branch",
            "pos",
            F.upper("path").alias("path_key"),
            F.coalesce(F.lower("type") == "tree", F.lit(False)).alias("is_tree"),
            parts.alias("parts"),
        )
        .filter(F.size("parts") > 0)
        .select("repo", "branch", "pos", "path_key", F.inline(offers))
    )
    return exploded.groupBy("repo", "branch", "node_key").agg(
        F.min("parent_key").alias("parent_key"),
        F.min_by("part", F.struct("path_key", "pos")).alias("name"),
        F.bool_or("dir").alias("is_dir"),
        F.min("depth").alias("depth"),
    )


def sibling_key() -> Column:
    """Byte order of this key among siblings: directories first, then names ignoring case."""
    return F.concat(F.when(F.col("is_dir"), F.lit(FIRST)).otherwise(F.lit(SECOND)), F.upper("name"))


def with_last_child(nodes: DataFrame) -> DataFrame:
    """Add `is_last`: no later sibling.

    The last child of each directory is found by an aggregation and joined back on the
    node's own, unique key, so that a directory with very many children stays spread.
    """
    last = (
        nodes.groupBy("repo", "branch", "parent_key")
        .agg(F.max_by("node_key", sibling_key()).alias("node_key"))
        .select("repo", "branch", "node_key", F.lit(True).alias("is_last"))
    )
    return nodes.join(last, ["repo", "branch", "node_key"], "left").withColumn(
        "is_last", F.coalesce("is_last", F.lit(False))
    )


def tree_lines(nodes: DataFrame) -> DataFrame:
    """One listing line per node with `line_key`, whose byte order is the listing order.

    Indents come from the flags of the directories above. Only directories look up
    their ancestors; every node then takes the finished indent of its parent.
    """
    keys = ["repo", "branch"]
    flagged = with_last_child(nodes)
    dirs = flagged.filter("is_dir").select(*keys, "node_key", "name", "is_last", "depth")

    parts = F.split("node_key", "/")
    chain = (
        dirs.select(
            *keys,
            "node_key",
            F.inline(
                F.transform(
                    F.sequence(F.lit(1), F.size(parts)),
                    lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")),
                )
            ),
        )
        .join(
            dirs.select(*keys, F.col("node_key").alias("above"), F.upper("name").alias("up"), "is_last"),
            [*keys, "above"],
        )
        .groupBy(*keys, "node_key")
        .agg(F.array_sort(F.collect_list(F.struct("level", "up", "is_last"))).alias("chain"))
    )
    # A chain has as many entries as the directory has levels.
    indents = chain.select(
        *keys,
        F.col("node_key").alias("parent_key"),
        F.array_join(F.transform("chain", lambda a: F.when(a["is_last"], SPACE).otherwise(RULE)), "").alias("indent"),
        F.array_join(
            F.transform("chain", lambda a: F.concat(F.lit(FIRST), a["up"], F.lit(LEVEL_END))), ""
        ).alias("above_key"),
    )
    placed = flagged.join(indents, [*keys, "parent_key"], "left")
    end = F.when(F.col("is_dir"), F.lit(LEVEL_END)).otherwise(F.lit(""))
    return placed.select(
        *keys,
        F.concat(F.coalesce("above_key", F.lit("")), sibling_key(), end).alias("line_key"),
        F.concat(
            F.coalesce("indent", F.lit("")),
            F.when(F.col("is_last"), LAST).otherwise(BRANCH),
            F.col("name"),
            F.when(F.col("is_dir"), "/").otherwise(""),
        ).alias("line"),
    )


def tree_listing(items: DataFrame, projects: DataFrame) -> DataFrame:
    """Lines of every repository's tree text, the `name/` line first (empty `line_key`)."""
    branches = items.select("repo", "branch").distinct()
    heads = branches.join(projects.select("repo", "name"), "repo", "left").select(
        "repo", "branch", F.lit("").alias("line_key"), F.concat(F.coalesce("name", "repo"), F.lit("/")).alias("line")
    )
    return heads.unionByName(tree_lines(tree_nodes(items)))


def tree_text(listing: DataFrame, piece_chars: int = 64_000_000) -> DataFrame:
    """Trees as text `(repo, branch, piece, tree_text)`, white space at the end cut.

    A tree is one piece unless it is longer than `piece_chars`; then it is cut between lines, and its pieces joined in
    order, with nothing between, give the whole. No cell and no group outgrows a task. Only the last line can end in white
    space that counts: a listing line always holds a connector.
    """
    stored = pinned(listing)
    last = stored.groupBy("repo", "branch").agg(F.max("line_key").alias("line_key")).withColumn("is_end", F.lit(True))
    lines = stored.join(last, ["repo", "branch", "line_key"], "left")
    line = F.when(F.col("is_end"), trim_end(F.col("line"))).otherwise(F.col("line"))
    lines = lines.select("repo", "branch", "line_key", F.concat(F.when(F.col("line_key") == "", "").otherwise("\n"), line).alias("line"))
    placed = running_totals(lines, ["repo", "branch"], ["line_key"], {"before": F.length("line")})
    ordered = F.array_sort(F.collect_list(F.struct("line_key", "line")))
    return (
        placed.groupBy("repo", "branch", F.call_function("div", F.col("before"), F.lit(piece_chars)).alias("piece"))
        .agg(F.array_join(F.transform(ordered, lambda p: p["line"]), "").alias("tree_text"))
    )

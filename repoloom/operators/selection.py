"""Select files by directory or by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.operators.ranking import running_totals
from repoloom.session import pinned

GROUP = ["repo", "branch"]


def select_files(inv: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Files of an inventory that a selection takes.

    A selection row `(repo, branch, prefix, explicit)` takes the selectable files below
    `prefix` (an empty prefix is the whole repository) unless they are large; an
    explicit row also takes the file it names when that is large. Without a selection
    every selectable file that is not large is taken, which needs no join.

    In the byte order of paths, what lies below a prefix is an interval, and so is the one name that equals it. Starts
    and ends of the intervals are rows among the files; a file is taken where the running count of open intervals is above zero.
    So rows neither multiply by the depth of a path nor meet in a join, a repository that holds most rows is cut by ranges of its
    paths (`running_totals`), and the inventory, which sniffs, is computed once and stored. Repeated rows stay repeated; a null
    repository, branch or prefix selects nothing.
    """
    if selection is None:
        return inv.filter(F.col("selectable") & ~F.col("large"))
    wanted = (
        selection.withColumn("_at", F.rtrim("prefix", F.lit("/")))
        .filter("_at is not null")
        .groupBy(*GROUP, "_at")
        .agg(F.bool_or(F.coalesce("explicit", F.lit(False))).alias("named"))
    )

    def edge(at, opened: int, named):
        return F.struct(at.alias("_at"), F.lit(opened).alias("_open"), named.alias("_named"))

    at, none = F.col("_at"), F.lit(0)
    exact = F.when(F.col("named"), 1).otherwise(0)
    # "0" follows "/", and a name followed by the character 0 is the next string after the name.
    below = F.array(edge(F.concat(at, F.lit("/")), 1, none), edge(F.concat(at, F.lit("0")), -1, none))
    itself = F.array(edge(at, 1, exact), edge(F.concat(at, F.lit("\0")), -1, -exact))
    edges = F.when(at == "", F.array(edge(at, 1, none))).otherwise(F.concat(below, itself))
    events = wanted.select(*GROUP, F.inline(edges)).withColumn("_file", F.lit(False))
    # Stored whole: a filter in front would have the optimizer copy the sniff into it.
    files = pinned(inv).filter("selectable").withColumns({"_at": F.col("path"), "_open": none, "_named": none, "_file": F.lit(True)})
    rows = files.unionByName(events, allowMissingColumns=True)
    # Edges come before files of the same place: false sorts first.
    counted = running_totals(rows, GROUP, ["_at", "_file"], {"_inside": F.col("_open"), "_exact": F.col("_named")})
    taken = F.when(F.col("large"), F.col("_exact") > 0).otherwise(F.col("_inside") > 0)
    return counted.filter(F.col("_file") & taken).select(*inv.columns)

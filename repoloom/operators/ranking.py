"""Positions and running totals inside groups that may be huge.

A window over (repo, branch) would put a repository that holds a third of all rows
into one task. Here rows are range-partitioned by group and order together, so a big
group spreads over many partitions; each partition counts for itself, and a table with
one row per (partition, group) carries the totals across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.session import pinned

PART = "_part"


def running_totals(
    df: DataFrame, group: list[str], order: list[str], measures: dict[str, Column]
) -> DataFrame:
    """Add, per measure, its total over the earlier rows of the group (exclusive).

    `order` must be a total order inside a group. The input should be narrow: it is
    read twice (for the range bounds and for the rows) and stored once.
    """
    ranged = df.withColumns({f"_m_{n}": m.cast("bigint") for n, m in measures.items()})
    ranged = ranged.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id())
    # The partition numbers must be the same for both branches below.
    rows = pinned(ranged)

    local = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    def total(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    carried = (
        rows.groupBy(PART, *group)
        .agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
        .select(PART, *group, *[total(f"_t_{n}", before).alias(f"_c_{n}") for n in measures])
    )
    inside = rows.withColumns({f"_l_{n}": total(f"_m_{n}", local) for n in measures})
    joined = inside.join(carried, [PART, *group])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in measures]
    )


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the row's position in its group, counted from 1."""
    return running_totals(df, group, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)

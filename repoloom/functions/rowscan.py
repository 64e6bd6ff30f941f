"""Stateful scans over an array column, inside one row.

A file is one row, so everything the lexing steps need is already together: a
scan with a small state gives the same answers as a window over exploded tokens,
without moving the text through a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def int_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by)).cast("int")


def chunks(items: Column, size: int) -> Column:
    last = int_div(F.greatest(F.size(items) - 1, F.lit(0)), size)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def scan(
    items: Column,
    state: dict[str, Column],
    emits: str,
    step: Callable[[Column, Column], Column],
    chunk: int | None = 64,
) -> Column:
    """Run `step` over `items` and return everything it emitted, in order.

    `step(state, item)` returns a struct with the fields of `state` plus `out`, the
    array of values emitted for this item. Spark copies the accumulator at every step,
    so emissions are gathered per chunk and only then added to the result; without
    `chunk` (for scans that emit little) there is one level. Keep strings out of state
    and emissions where numbers do.
    """
    nothing = F.array().cast(f"array<{emits}>")
    names = list(state)

    def start(values: dict[str, Column]) -> Column:
        return F.struct(*[v.alias(n) for n, v in values.items()], nothing.alias("out"))

    def joined(acc: Column, new: Column) -> Column:
        out = F.when(F.size(new["out"]) > 0, F.concat(acc["out"], new["out"])).otherwise(acc["out"])
        return F.struct(*[new[n].alias(n) for n in names], out.alias("out"))

    def advance(acc: Column, item: Column) -> Column:
        return let(step(acc, item), lambda new: joined(acc, new))

    if chunk is None:
        return F.aggregate(items, start(state), advance, lambda acc: acc["out"])

    def part(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, start({n: acc[n] for n in names}), advance)
        return let(inner, lambda new: joined(acc, new))

    return let(
        items, lambda all_items: F.aggregate(chunks(all_items, chunk), start(state), part, lambda acc: acc["out"])
    )


def running_starts(sizes: Column) -> Column:
    """For each size, the sum of the sizes before it."""
    return scan(
        sizes,
        {"at": F.lit(0)},
        "int",
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array(acc["at"]).alias("out")),
    )


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator that yields one row.

    The optimizer copies the definition of a projected column into every filter on
    it, which for these stages repeats the whole scan; it does not look through a
    generator.
    """
    added = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], added)

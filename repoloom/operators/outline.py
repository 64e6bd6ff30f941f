"""Nest the functions of a file, and cut the file along that outline.

All steps work on arrays inside the file's row; spans of a file are few.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.rowscan import fenced, let, scan
from repoloom.functions.text import is_blank, md_anchor

STACKED = "struct<ord:int,start:int,end:int>"
SEGMENT = "struct<kind:string,ord:int,start:int,end:int>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def sorted_spans(spans: Column) -> Column:
    """By start, then longest first, then order of emission."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), i.alias("nth"), s.alias("s")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def nested(spans: Column) -> Column:
    """Spans with their parent: the latest earlier span that strictly contains them.

    A stack of open spans is carried along; every member contains the next one, so
    keeping those that contain the new span is the same as popping the others.
    """

    def step(acc: Column, s: Column) -> Column:
        holds = F.filter(
            acc["stack"],
            lambda p: (s["start"] >= p["start"])
            & (s["end"] <= p["end"])
            & ((s["start"] > p["start"]) | (s["end"] < p["end"])),
        )
        item = F.struct(acc["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"))
        return let(
            holds,
            lambda stack: F.struct(
                (acc["ord"] + 1).alias("ord"),
                F.concat(stack, F.array(item)).alias("stack"),
                F.array(F.transform(stack, lambda p: p["ord"])).alias("out"),
            ),
        )

    def named(ordered: Column) -> Column:
        numbers = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        chains = scan(numbers, {"ord": F.lit(1), "stack": _none(STACKED)}, "array<int>", step)
        pairs = F.zip_with(ordered, chains, lambda s, above: F.struct(s.alias("s"), above.alias("above")))
        return F.transform(
            pairs,
            lambda p, i: F.struct(
                (i + 1).alias("ord"),
                F.coalesce(F.get(p["above"], F.size(p["above"]) - 1), F.lit(0)).alias("parent_ord"),
                F.size(p["above"]).alias("depth"),
                p["s"]["name"].alias("name"),
                F.array_join(
                    F.concat(F.transform(p["above"], lambda o: F.get(ordered, o - 1)["name"]), F.array(p["s"]["name"])), "."
                ).alias("qualified_name"),
                p["s"]["start"].alias("start"),
                p["s"]["end"].alias("end"),
            ),
        )

    return let(spans, named)


def occurrences(entries: Column) -> Column:
    """For each entry, how often its qualified name (ignoring case) occurred so far."""
    keyed = F.array_sort(
        F.transform(entries, lambda e: F.struct(F.upper(e["qualified_name"]).alias("key"), e["ord"].alias("ord")))
    )

    def step(acc: Column, k: Column) -> Column:
        nth = F.when(k["key"] == acc["key"], acc["nth"] + 1).otherwise(F.lit(1))
        return F.struct(
            k["key"].alias("key"),
            nth.alias("nth"),
            F.array(F.struct(k["ord"].alias("ord"), nth.alias("nth"))).alias("out"),
        )

    state = {"key": F.lit(None).cast("string"), "nth": F.lit(0)}
    return F.transform(F.array_sort(scan(keyed, state, "struct<ord:int,nth:int>", step)), lambda o: o["nth"])


@cache
def _entries() -> Column:
    return nested(sorted_spans(F.col("spans")))


@cache
def _labelled() -> Column:
    def label(entries: Column) -> Column:
        return F.zip_with(
            entries,
            occurrences(entries),
            lambda e, n: F.struct(
                *[e[f].alias(f) for f in ("ord", "parent_ord", "depth", "name", "qualified_name", "start", "end")],
                F.when(n == 1, e["qualified_name"])
                .otherwise(F.concat(e["qualified_name"], F.lit(" ("), n.cast("string"), F.lit(")")))
                .alias("display_name"),
                md_anchor(
                    F.concat(
                        F.lit("fn::"), F.col("path"), F.lit("::"), e["qualified_name"], F.lit("::"), e["start"].cast("string")
                    )
                ).alias("anchor"),
            ),
        )

    return let(_entries(), label)


def with_outline(df: DataFrame) -> DataFrame:
    """Add `entries`, the outline in reading order, to files that have `spans`."""
    return fenced(df, entries=_labelled())


@cache
def _segments() -> Column:
    entries = F.col("entries")
    length = F.length("text")
    box = "struct<ord:int,depth:int,cursor:int,end:int>"

    def as_box(ord_: Column, depth: Column, cursor: Column, end: Column) -> Column:
        return F.struct(ord_.alias("ord"), depth.alias("depth"), cursor.alias("cursor"), end.alias("end"))

    def segment(kind: str, ord_: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ord_.alias("ord"), start.alias("start"), end.alias("end"))

    # Each entry with the depth of the one after it; a closing entry ends the file.
    fields = ("ord", "depth", "start", "end")
    with_next = F.transform(
        entries,
        lambda e, i: F.struct(
            *[e[f].alias(f) for f in fields], F.coalesce(F.get(entries, i + 1)["depth"], F.lit(0)).alias("next_depth")
        ),
    )
    closing = F.struct(
        F.lit(0).alias("ord"), F.lit(-1).alias("depth"), length.alias("start"), length.alias("end"), F.lit(-1).alias("next_depth")
    )

    def step(acc: Column, e: Column) -> Column:
        """Close what ends before this entry, then the gap, the heading and the body."""
        closed = F.filter(acc["open"], lambda b: b["depth"] >= e["depth"])
        kept = F.filter(acc["open"], lambda b: b["depth"] < e["depth"])
        tails = F.transform(
            F.filter(F.reverse(closed), lambda b: b["cursor"] < b["end"]),
            lambda b: segment("tail", b["ord"], b["cursor"], b["end"]),
        )

        def enter(stack: Column) -> Column:
            parent = F.get(stack, F.size(stack) - 1)
            moved = F.concat(
                F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))),
                F.array(as_box(parent["ord"], parent["depth"], e["end"], parent["end"])),
            )
            gap = F.when(
                e["start"] > parent["cursor"], F.array(segment("gap", e["ord"], parent["cursor"], e["start"]))
            ).otherwise(_none(SEGMENT))
            head = F.array(segment("heading", e["ord"], e["start"], e["end"]))
            leaf = e["next_depth"] <= e["depth"]
            body = F.when(leaf, F.array(segment("body", e["ord"], e["start"], e["end"]))).otherwise(_none(SEGMENT))
            inside = F.when(leaf, _none(box)).otherwise(F.array(as_box(e["ord"], e["depth"], e["start"], e["end"])))
            return F.struct(F.concat(moved, inside).alias("open"), F.concat(tails, gap, head, body).alias("out"))

        return F.when(e["depth"] < 0, F.struct(_none(box).alias("open"), tails.alias("out"))).otherwise(let(kept, enter))

    whole_file = F.array(as_box(F.lit(0), F.lit(-1), F.lit(0), length))
    return scan(F.concat(with_next, F.array(closing)), {"open": whole_file}, SEGMENT, step)


def with_segments(df: DataFrame) -> DataFrame:
    """Add `segments`: gaps, headings, bodies and tails of a file in document order."""
    return fenced(df, segments=_segments())


def outline(units: DataFrame) -> DataFrame:
    """One row per function of files with `spans`: order, parent, depth, names, anchor."""
    return with_outline(units).select("repo", "branch", "path", F.inline("entries"))


def code_segments(units: DataFrame) -> DataFrame:
    """One row per segment of files with `spans` and `text`, blank pieces dropped."""
    df = with_segments(with_outline(units)).select("repo", "branch", "path", "text", F.posexplode("segments").alias("seg", "segment"))
    piece = F.when(F.col("segment.kind") != "heading", F.expr("substring(text, segment.start + 1, segment.end - segment.start)"))
    return (
        df.select("repo", "branch", "path", "seg", "segment.*", piece.alias("code"))
        .filter((F.col("kind") == "heading") | ~is_blank(F.col("code")))
    )


def span_parents(spans: DataFrame) -> DataFrame:
    """Parents for a table of spans without text: `(repo, branch, path, emit_pos, name, start, end)`.

    Spans are gathered per file and nested in the row.
    """
    per_file = spans.groupBy("repo", "branch", "path").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("emit_pos", "name", "start", "end"))),
            lambda s: F.struct(s["name"].alias("name"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias("spans")
    )
    return per_file.select("repo", "branch", "path", F.inline(_entries()))

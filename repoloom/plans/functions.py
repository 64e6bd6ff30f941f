"""The function-inventory job: names and spans of functions in seven dialects.

One pass over the corpus. Each stage is a column of the file's own row, chosen by
dialect, so there is no shuffle and the text is scanned once, whatever the number
of dialects; files of other languages skip every stage.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.rowscan import fenced, let, scan
from repoloom.operators import signatures as sig
from repoloom.operators.blocks import block_ends
from repoloom.operators.trivia import leading_start

# Language tag to dialect; other languages have no functions.
DIALECTS = {
    "csharp": "csharp",
    "javascript": "js",
    "typescript": "js",
    "java": "java",
    "python": "python",
    "lua": "lua",
    "php": "php",
    "rust": "rust",
}
LEXED = ("csharp", "js", "php", "rust", "lua", "python")
SPAN = "struct<name:string,start:int,end:int>"


def dialect_of(language: Column, unknown: Column | None = None) -> Column:
    """Dialect of a file, null when functions are not looked for."""
    pairs = [F.lit(x) for kv in DIALECTS.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), language)
    return found if unknown is None else F.when(~unknown, found)


def by_dialect(branches: dict[str, Column], default: Column) -> Column:
    """CASE over the dialect; only the matching branch is evaluated for a row."""
    chain = None
    for name, value in branches.items():
        cond = F.col("dialect") == name
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise(default)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# The stage expressions below name fixed columns and depend on nothing else, so each
# is built once per process.


@cache
def _signatures() -> Column:
    text = F.col("lex_text")
    return by_dialect(
        {
            "csharp": F.concat(sig.csharp_methods(text), sig.csharp_types(text)),
            "js": let(sig.js_candidates(text), sig.js_signatures),
            "java": sig.matches(text, "java"),
            "python": sig.matches(text, "python"),
            "lua": sig.lua_candidates(text),
            "php": sig.matches(text, "php"),
            "rust": sig.matches(text, "rust"),
        },
        _empty(sig.SIGNATURE),
    )


def prepared(units: DataFrame) -> DataFrame:
    """Add `dialect` and `lex_text`, the text without the characters used as marks.

    `units` needs `language` and `text`, and may have `is_unknown`.
    """
    unknown = F.col("is_unknown") if "is_unknown" in units.columns else None
    df = units.withColumn("dialect", dialect_of(F.col("language"), unknown))
    df = df.withColumn("lex_text", F.when(F.col("dialect").isNotNull(), sig.clean_marks(F.col("text"))))
    return df


def signatures(units: DataFrame) -> DataFrame:
    """Add `sigs`, the array of signatures of each file."""
    return fenced(prepared(units), sigs=_signatures())


def _lexed_spans(dialect: str) -> Column:
    """Signatures with start and end; those without a body are dropped."""
    text, sigs = F.col("lex_text"), F.col("sigs")

    def spans(ends: Column) -> Column:
        return F.transform(
            sigs,
            lambda s, i: F.struct(
                s["rule"].alias("rule"),
                s["name"].alias("name"),
                leading_start(text, s, dialect).alias("start"),
                F.get(ends, i).alias("end"),
                s["brace"].alias("body"),
            ),
        )

    return F.filter(let(block_ends(text, sigs, dialect), spans), lambda s: (s["end"] >= 0) & (s["end"] > s["start"]))


def is_type(span: Column) -> Column:
    return span["rule"] == "csharp_type"


def without_inner(types: Column, others: Column) -> Column:
    """Types in whose body none of the other spans starts.

    One pass from the last position to the first knows, at each body, the nearest start
    after it; that one decides. Starts at the body itself do not count, so they are met
    after it.
    """
    points = F.concat(
        F.transform(others, lambda s: F.struct((-s["start"]).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("nth"))),
        F.transform(types, lambda t, i: F.struct((-t["body"]).alias("at"), F.lit(0).alias("kind"), i.alias("nth"))),
    )

    def step(acc: Column, p: Column) -> Column:
        is_start = p["kind"] == 1
        return F.struct(
            F.when(is_start, -p["at"]).otherwise(acc["next"]).alias("next"),
            F.when(is_start, F.array().cast("array<struct<nth:int,next:int>>"))
            .otherwise(F.array(F.struct(p["nth"].alias("nth"), acc["next"].alias("next"))))
            .alias("out"),
        )

    found = F.array_sort(scan(F.array_sort(points), {"next": F.lit(2147483647)}, "struct<nth:int,next:int>", step))
    kept = F.zip_with(types, found, lambda t, f: F.when(f["next"] >= t["end"], t))
    return F.filter(kept, lambda t: t.isNotNull())


def leaf_types(spans: Column) -> Column:
    """C# types without a method or another type starting inside their body."""
    types = F.filter(spans, is_type)
    return without_inner(without_inner(types, F.filter(spans, lambda s: ~is_type(s))), types)


def csharp_order(spans: Column) -> Column:
    """Methods and leaf types by start, then end; methods first where both are equal."""
    keyed = F.transform(
        F.concat(F.filter(spans, lambda s: ~is_type(s)), leaf_types(spans)),
        lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("nth"), s.alias("s")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _java_spans() -> Column:
    """A Java span runs from one signature to the next, or to the end of the file."""
    sigs = F.col("sigs")
    return F.transform(
        sigs,
        lambda s, i: F.struct(
            s["rule"].alias("rule"),
            s["name"].alias("name"),
            s["idx"].alias("start"),
            F.coalesce(F.get(sigs, i + 1)["idx"], F.length("lex_text")).alias("end"),
            s["brace"].alias("body"),
        ),
    )


RAW_SPAN = "struct<rule:string,name:string,start:int,end:int,body:int>"


@cache
def _raw_spans() -> Column:
    return by_dialect({**{d: _lexed_spans(d) for d in LEXED}, "java": _java_spans()}, _empty(RAW_SPAN))


def all_spans(units: DataFrame) -> DataFrame:
    """Add `raw_spans`: spans per file, for C# with every type, leaf or not."""
    df = signatures(units)
    return fenced(df, raw_spans=_raw_spans())


def valid_spans(spans: Column, length: Column) -> Column:
    """Spans that lie inside a text of the given length and are not empty."""
    return F.filter(
        spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= length)
    )


@cache
def _spans() -> Column:
    raw = F.col("raw_spans")
    ordered = F.when(F.col("dialect") == "csharp", csharp_order(raw)).otherwise(raw)
    named = F.transform(
        ordered, lambda s: F.struct(s["name"].alias("name"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return F.coalesce(named, _empty(SPAN))


def with_spans(units: DataFrame) -> DataFrame:
    """Add `spans`: the functions of each file in emission order."""
    df = all_spans(units)
    return fenced(df, spans=_spans()).drop("dialect", "lex_text", "sigs", "raw_spans")


KEYS = ("repo", "branch", "path")


def function_spans(units: DataFrame) -> DataFrame:
    """One row per function: keys, emit_pos, name, start (inclusive), end (exclusive)."""
    df = with_spans(units).select(*KEYS, F.posexplode("spans").alias("emit_pos", "span"))
    return df.select(*KEYS, "emit_pos", "span.name", "span.start", "span.end")


def function_names(units: DataFrame) -> DataFrame:
    """One row per function name. C# and Java list every signature whose name is no keyword."""
    df = all_spans(units)
    listed = F.filter(F.col("sigs"), lambda s: s["rule"] == "csharp_method")
    java = sig.without_names(F.col("sigs"), sig.JAVA_KEYWORDS, ignore_case=False)
    names = F.when(F.col("dialect") == "csharp", F.transform(listed, lambda s: s["name"])).otherwise(
        F.when(F.col("dialect") == "java", F.transform(java, lambda s: s["name"])).otherwise(
            F.transform(F.col("raw_spans"), lambda s: s["name"])
        )
    )
    return df.select(*KEYS, F.posexplode(F.coalesce(names, _empty("string"))).alias("emit_pos", "name"))

"""Lines, tokens and bracket pairs of whole files, as tables.

These are the tables to analyse a corpus by line or by bracket. The function job does
not need them: it answers per signature inside the file's row. Text is cut into pieces
on the map side and only numbers (lengths, kinds) go through the one shuffle that the
window per file needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.functions.paths import WHITE_SPACE
from repoloom.operators.lexing import TOKENS, tokens
from repoloom.plans.functions import by_dialect, prepared

KEYS = ["repo", "branch", "path"]


def _offsets(df: DataFrame, nth: str, size: str) -> Column:
    earlier = Window.partitionBy(*KEYS).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int")


def lines(units: DataFrame) -> DataFrame:
    """Lines of each text: number, start, end (before the line feed), start of the next, indent.

    `next_start` is null on the last line; a line feed at the very end starts no line
    that has text.
    """
    line = F.col("line")
    cut = units.select(*KEYS, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    sized = cut.select(
        *KEYS,
        "line_no",
        F.length(line).alias("chars"),
        (F.length(line) + 1).alias("size"),
        (F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))).alias("indent"),
        (F.trim(line, F.lit(WHITE_SPACE)) == "").alias("blank"),
    )
    after = Window.partitionBy(*KEYS).orderBy("line_no")
    placed = sized.withColumn("line_start", _offsets(sized, "line_no", "size"))
    return placed.select(
        *KEYS,
        "line_no",
        "line_start",
        (F.col("line_start") + F.col("chars")).alias("line_end"),
        F.lead("line_start").over(after).alias("next_start"),
        "indent",
        "blank",
    )


def code_tokens(units: DataFrame) -> DataFrame:
    """Tokens at code level (outside strings and comments): `(…, dialect, nth, off, token)`."""
    df = prepared(units)
    found = by_dialect({d: tokens(F.col("lex_text"), d) for d in TOKENS}, F.array().cast("array<string>"))
    piece = F.col("piece")
    sized = df.select(*KEYS, "dialect", F.posexplode(found).alias("nth", "piece")).select(
        *KEYS,
        "dialect",
        "nth",
        F.length(piece).alias("size"),
        F.when(F.col("dialect") == "lua", F.regexp_extract(piece, r"(function|if|for|while|repeat|until|end)\z", 1))
        .when(F.endswith(piece, F.lit("=>")) & (F.col("dialect") == "js"), F.lit("=>"))
        .otherwise(F.substring(piece, -1, 1))
        .alias("token"),
    )
    off = _offsets(sized, "nth", "size") + F.col("size") - F.length("token")
    return (
        sized.withColumn("off", off)
        .filter((F.col("token") != "") & (F.col("token") != "\x02"))
        .select(*KEYS, "dialect", "nth", "off", "token")
    )


def brace_depth(found: DataFrame) -> DataFrame:
    """Opening and closing tokens with the depth after them and their level.

    Level is the depth inside the block: after an opening token, before a closing one.
    """
    step = F.when(F.col("token").isin("{", "function", "if", "for", "while", "repeat"), 1).when(
        F.col("token").isin("}", "end", "until"), -1
    )
    so_far = Window.partitionBy(*KEYS).orderBy("nth")
    df = found.withColumn("step", step).filter(F.col("step").isNotNull())
    df = df.withColumn("depth", F.sum("step").over(so_far).cast("int"))
    return df.withColumn("level", F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1))


def block_pairs(depths: DataFrame) -> DataFrame:
    """Each opening token with its closing one: in a level they alternate, so it is the next."""
    per_level = Window.partitionBy(*KEYS, "level").orderBy("nth")
    df = depths.withColumn("close_off", F.lead("off").over(per_level)).withColumn(
        "close_token", F.lead("token").over(per_level)
    )
    return df.filter((F.col("step") > 0) & F.col("close_off").isNotNull()).select(
        *KEYS, "dialect", "level", F.col("off").alias("open_off"), "close_off", "close_token"
    )

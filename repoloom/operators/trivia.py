"""Extend a function's start upwards over the comment and attribute lines above it.

Walking up is reading the reversed text forwards: a possessive pattern over whole
(reversed) lines stops at the first line that is not trivia. Blank lines are crossed,
and kept only when something above them is kept (PHP keeps them always).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.rowscan import let
from repoloom.operators.signatures import ABOVE

WS = r"[\s&&[^\n]]*+"
EOL = r"(?=\n|\z)"
BLANK = rf"\n{WS}{EOL}"


def _begins(*heads: str) -> str:
    """A line that starts, after white space, with one of the (reversed) heads."""
    return rf"\n[^\n]*(?:{'|'.join(heads)}){WS}{EOL}"


ENDS_COMMENT = rf"(?={WS}/\*)"
OPENS = _begins(r"\*/")
# Inside a block comment: every line up to and including the one that opens it.
INSIDE = rf"(?:(?:{BLANK})*+(?!{BLANK})(?!{OPENS})\n[^\n]*+)*+(?:(?:{BLANK})*+{OPENS})?+"


def _walk(keep: list[str], enter: list[str] = []) -> str:
    units = keep + [f"(?:{e}){INSIDE}" for e in enter]
    return rf"(?U)\A(?:(?:{BLANK})*+(?:{'|'.join(units)}))*+"


ONE_LINE_BLOCK = rf"\n{ENDS_COMMENT}[^\n]*\*/{WS}{EOL}"
STARRED = rf"\n(?!{WS}/\*)[^\n]*\*{WS}{EOL}"
TO_BLOCK = rf"\n{ENDS_COMMENT}[^\n]*+"

# Which lines above a function belong to it, by dialect (heads reversed).
WALKS = {
    "csharp": _walk([_begins("//"), rf"\n{WS}\][^\n]*\[{WS}{EOL}", ONE_LINE_BLOCK, STARRED], [TO_BLOCK]),
    "js": _walk([_begins("//", "@"), ONE_LINE_BLOCK, STARRED], [TO_BLOCK]),
    "python": _walk([_begins("#")]),
    "lua": _walk([_begins("--")]),
    "php": rf"(?U)\A(?:{BLANK}|{_begins('//', '#', r'[*]/', r'[*]')})*+",
    "rust": _walk([_begins(r"\[#", r"\[!#", "//", r"\*/")], [TO_BLOCK, _begins(r"\*")]),
}


def leading_start(text: Column, s: Column, dialect: str) -> Column:
    """Start of the function with signature `s`, trivia included.

    The lines between the signature before (which starts a line) and this one decide
    nearly always: the line that stops the walk must lie among them as a whole. If not,
    all the text above is read.
    """
    idx, above = s["idx"], s["above"]

    def size(lines: Column) -> Column:
        return F.length(F.regexp_extract(lines, WALKS[dialect], 0))

    def decide(lines: Column) -> Column:
        whole = (F.length(lines) == idx) | (F.length(lines) < ABOVE)
        return let(
            size(lines),
            lambda n: F.when(
                (F.length(lines) == idx)
                | (whole & (n < F.length(lines)))
                | (F.call_function("locate", F.lit("\n"), lines, n + 2) > 0),
                idx - n,
            ).otherwise(idx - size(F.reverse(F.substring(text, F.lit(1), idx)))),
        )

    return F.when(idx == 0, F.lit(0)).otherwise(let(F.reverse(above), decide))

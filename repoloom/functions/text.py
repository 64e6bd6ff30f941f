"""Column expressions on text: blanks, Markdown pieces, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.paths import WHITE_SPACE
from repoloom.functions.rowscan import let


def is_blank(value: Column) -> Column:
    """True for null, empty or all-white-space text."""
    return value.isNull() | (F.trim(value, F.lit(WHITE_SPACE)) == "")


def trim_end(value: Column) -> Column:
    return F.rtrim(value, F.lit(WHITE_SPACE))


def md_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\`*_{}\[\]()#+\-!|<>])", r"\\$1")


def md_anchor(value: Column) -> Column:
    """Readable slug plus the first 8 hex digits of the text's SHA-256."""
    slug = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}_]+", "-"), F.lit("-"))
    named = F.coalesce(F.nullif(slug, F.lit("")), F.lit("section"))
    return F.when(is_blank(value), F.lit("section")).otherwise(
        F.concat(named, F.lit("-"), F.substring(F.sha2(value, 256), 1, 8))
    )


def md_code_block(language: Column, value: Column) -> Column:
    """Fenced block, null for blank text."""
    return let(
        trim_end(value),
        lambda code: F.when(code != "", F.concat(F.lit("~~~"), language, F.lit("\n"), code, F.lit("\n~~~\n\n"))),
    )


def safe_name(value: Column, fallback: str = "inconnu") -> Column:
    """Part of a file name without the characters Windows forbids."""
    cleaned = F.trim(F.regexp_replace(value, r'["<>|:*?\\/\x00-\x1f]', "-"), F.lit(" ."))
    return F.when(is_blank(value) | is_blank(cleaned), F.lit(fallback)).otherwise(cleaned)


def package_name(stamp: Column, project: Column, branch: Column) -> Column:
    return F.concat(
        F.date_format(stamp, "yyMMdd HHmmss"),
        F.lit(" "),
        safe_name(project),
        F.lit(" ["),
        safe_name(branch),
        F.lit("].md"),
    )


def format_size(size: Column, unknown: str = "taille inconnue", unit: str = "Mo") -> Column:
    return F.when(size.isNull(), F.lit(unknown)).otherwise(
        F.format_string(f"%.1f {unit}", size / F.lit(1048576.0))
    )

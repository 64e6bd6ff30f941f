"""Find function signatures, with their offsets, by one regular expression each.

Offsets are counted in code points. Text handed to these functions must not hold
the control characters used as marks; `clean_marks` exchanges them first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.rowscan import let, running_starts

MARK, END, SEP, STAND_IN = "\x01", "\x02", "\x03", "\x04"

# Signature patterns and the group that holds the name. `^` follows a
# line feed only, \w and \s are Unicode-aware. Runs of white space are possessive and
# the C# and Java patterns are reduced to equivalent forms that do not backtrack
# through every split of a white-space run.
FLAGS = r"(?md)(?U)"
PATTERNS = {
    "csharp_method": (
        r"^\s*+(?:\[[^\]]*+\]\s*+)*+(?=[\w<>\[\],\s?@]*+\()(?:[\w<>\[\],\s?]+\s)?([@\w]++)\s*+\([^;{]*\)\s*+\{",
        1,
    ),
    "csharp_type": (
        r"^\s*+(?:\[[^\]]*+\]\s*+)*+"
        r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|file)\s++)*+"
        r"((?:class|struct|interface|record)\s++[@\w]++)[^;{]*+\{",
        1,
    ),
    "js_function": (r"^\s*+(?:export\s++)?(?:default\s++)?(?:async\s++)?function\s++([\w$]++)\s*+\(", 1),
    "js_arrow": (
        r"^\s*+(?:export\s++)?(?:const|let|var)\s++([\w$]++)\s*+=\s*+(?:async\s++)?(?:\([^)]*+\)|[\w$]++)\s*+=>",
        1,
    ),
    "js_method": (r"^\s*+(?:static\s++)?(?:async\s++)?([\w$]++)\s*+\([^)]*+\)\s*+\{", 1),
    "java": (
        r"^(?:(?:\s*(?:public|private|protected|static|final|synchronized|abstract|native))*\s*[\s&&[^ ]]"
        r"|[ ]|public|private|protected|static|final|synchronized|abstract|native)"
        r"[\w<>\[\], ?.]+\s++([A-Za-z_]\w*+)\s*+\(",
        1,
    ),
    "python": (r"^[ \t]*+(?:async\s++)?def\s++([A-Za-z_]\w*+)\s*+\(", 1),
    "lua_named": (r"^\s*+(?:local\s++)?function\s++([A-Za-z_]\w*+(?:[.:][A-Za-z_]\w*+)*+)\s*+\(", 1),
    "lua_assigned": (
        r"^\s*+(?:local\s++)?([A-Za-z_]\w*+(?:[.:][A-Za-z_]\w*+)*+)\s*+=\s*+function\s*+\(",
        1,
    ),
    "php": (
        r"^\s*+(?:(?:public|private|protected)\s++)?(?:static\s++)?function\s++&?\s*+([A-Za-z_]\w*+)\s*+"
        r"\([^)]*+\)\s*+(?::\s*+[A-Za-z_\\|?\w]++\s*+)?\{",
        1,
    ),
    "rust": (
        r"^\s*+(?:pub(?:\s*+\([^)]*+\))?\s++)?(?:default\s++)?(?:const\s++)?(?:async\s++)?(?:unsafe\s++)?"
        r'(?:extern\s++(?:"[^"]*+"\s++)?)?fn\s++([A-Za-z_]\w*+)\s*+(?:<[^;\r\n{]*(?:>|\r?\n))?\s*+\(',
        1,
    ),
}

# Names that are statements, not functions (the first two ignore case).
CSHARP_KEYWORDS = "if for foreach while switch catch using lock return throw do else try".split()
JS_KEYWORDS = "if for while switch catch function else do try constructor".split()
JAVA_KEYWORDS = "if for while switch catch return new throw do".split()

# A match with the text up to the next one and the last characters above it.
ABOVE = 1000
FIELDS = ("rule", "name", "idx", "brace", "piece", "above")
SIGNATURE = "struct<rule:string,name:string,idx:int,brace:int,piece:string,above:string>"


def clean_marks(text: Column) -> Column:
    return F.translate(text, MARK + END + SEP, STAND_IN * 3)


def matches(text: Column, rule: str) -> Column:
    """Array of matches: name, start, where the block opens, and the text up to the next match."""
    pattern, group = PATTERNS[rule]
    marked = F.regexp_replace(text, FLAGS + pattern, f"{MARK}${group}{END}$0{SEP}")

    # After the split: the text before any match, then name, match and rest of each.
    def located(items: Column) -> Column:
        plain = F.transform(
            items,
            lambda item, i: F.when(i == 0, item).otherwise(
                F.replace(F.substring(item, F.instr(item, END) + 1, F.length(item)), F.lit(SEP), F.lit(""))
            ),
        )
        return let(
            plain,
            lambda texts: let(
                running_starts(F.transform(texts, F.length)), lambda starts: described(items, texts, starts)
            ),
        )

    def described(items: Column, texts: Column, starts: Column) -> Column:
        return F.transform(
            F.slice(items, F.lit(2), F.size(items)),
            lambda item, i: let(
                F.substring_index(item, END, 1),
                lambda name: F.struct(
                    F.lit(rule).alias("rule"),
                    name.alias("name"),
                    F.get(starts, i + 1).alias("idx"),
                    (F.get(starts, i + 1) + BRACE[rule](item, name)).alias("brace"),
                    F.get(texts, i + 1).alias("piece"),
                    F.substring(F.get(texts, i), -ABOVE, ABOVE).alias("above"),
                ),
            ),
        )

    items = F.split(marked, MARK, -1)
    return let(items, lambda a: F.when(F.size(a) > 1, located(a)).otherwise(F.array().cast(f"array<{SIGNATURE}>")))


def _match_end(item: Column, name: Column) -> Column:
    """Distance from the match's start to its last character."""
    return F.instr(item, SEP) - F.length(name) - 3


def _first_brace(item: Column, name: Column) -> Column:
    return F.locate("{", item, 1) - F.length(name) - 2


# Where the block of a match opens, seen from the match's start.
BRACE = {rule: _match_end if rule.startswith("csharp") else lambda item, name: F.lit(0) for rule in PATTERNS}
BRACE["php"] = _first_brace


def without_names(found: Column, names: list[str], ignore_case: bool) -> Column:
    """Matches of other names; what follows a dropped match belongs to the piece of the one before."""

    def kept(at: Column) -> Column:
        def joined(k: Column, i: Column) -> Column:
            m, following = F.get(found, k), F.coalesce(F.get(at, i + 1), F.size(found))
            piece = F.when(following == k + 1, m["piece"]).otherwise(
                F.array_join(F.transform(F.slice(found, k + 1, following - k), lambda d: d["piece"]), "")
            )
            return F.struct(*[(piece if n == "piece" else m[n]).alias(n) for n in FIELDS])

        return F.transform(at, joined)

    keep = F.transform(found, lambda m, i: F.when(~(F.lower(m["name"]) if ignore_case else m["name"]).isin(*names), i))
    return let(F.filter(keep, lambda i: i.isNotNull()), kept)


def by_position(found: Column) -> Column:
    """Stable order by start; rules listed first win ties."""
    return F.transform(
        F.array_sort(F.transform(found, lambda m, i: F.struct(m["idx"].alias("at"), i.alias("nth"), m.alias("m")))),
        lambda s: s["m"],
    )


def csharp_methods(text: Column) -> Column:
    return let(matches(text, "csharp_method"), lambda found: without_names(found, CSHARP_KEYWORDS, ignore_case=True))


def csharp_types(text: Column) -> Column:
    return F.transform(
        matches(text, "csharp_type"),
        lambda m: F.struct(
            m["rule"].alias("rule"),
            F.regexp_replace(m["name"], r"(?U)\s+", " ").alias("name"),
            m["idx"].alias("idx"),
            m["brace"].alias("brace"),
            m["piece"].alias("piece"),
            m["above"].alias("above"),
        ),
    )


def js_candidates(text: Column) -> Column:
    """The three JavaScript forms together, before duplicates are dropped."""
    methods = let(matches(text, "js_method"), lambda found: without_names(found, JS_KEYWORDS, ignore_case=True))
    return by_position(F.concat(matches(text, "js_function"), matches(text, "js_arrow"), methods))


def js_signatures(candidates: Column) -> Column:
    """First candidate of each (name, start)."""
    return F.filter(
        candidates,
        lambda m, i: ~F.exists(
            F.slice(candidates, F.greatest(i - 2, F.lit(0)) + 1, F.least(i, F.lit(2))),
            lambda o: (o["idx"] == m["idx"]) & (o["name"] == m["name"]),
        ),
    )


def lua_candidates(text: Column) -> Column:
    return by_position(F.concat(matches(text, "lua_named"), matches(text, "lua_assigned")))

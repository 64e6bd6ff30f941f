"""Exact fallback: find where one block ends by a scan over the tokens that follow.

`blocks` answers nearly every signature with one regular expression. What such an
expression cannot decide (nesting beyond the unrolled depth, odd bracket orders) is
answered here by a state carried along the tokens. Tokens are found by one pattern per
dialect: a possessive run of everything that does not matter (plain text, strings,
comments) and then one character or word that does. `MARK` stands at the position
asked about, `END` closes the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.paths import WHITE_SPACE
from repoloom.functions.rowscan import int_div, let, scan
from repoloom.operators.signatures import END, MARK

STOP = r"\x01\x02"
LINE_SLASH = r"//[^\n\x02]*+"
BLOCK = r"/\*(?:[^*\x02]++|\*(?!/))*+(?:\*/)?+"


def quoted(q: str) -> str:
    return rf"{q}(?:[^{q}\\\x02]++|\\[^\x02])*+(?:{q}|\\)?+"


def nested_block(depth: int) -> str:
    """Block comments that nest, unrolled to `depth` levels; each may stay open."""
    inner = ""
    for _ in range(depth):
        inner = rf"/\*(?:[^*/\x02]++|\*(?!/)|/(?!\*){'|' + inner if inner else ''})*+(?:\*/)?+"
    return inner


# Levels of nested comments that a pattern decides; deeper ones are counted (`shallow`).
PATTERN_LEVELS = 8
# What each dialect skips, and the characters or words that count.
CSHARP_SKIP = "|".join([LINE_SLASH, BLOCK, r'@"(?:[^"\x02]++|"")*+"?+', quoted('"'), quoted("'")])
JS_SKIP = "|".join([LINE_SLASH, BLOCK, quoted('"'), quoted("'"), quoted("`")])
PHP_SKIP = "|".join([LINE_SLASH, r"#[^\n\x02]*+", BLOCK, r"\\[\\\"']", quoted('"'), quoted("'")])
RUST_PARTS = [
    LINE_SLASH,
    nested_block(PATTERN_LEVELS),
    r'r(#*+)"(?:[^"\x02]++|"(?!\1))*+(?:"\1)?+',
    quoted('"'),
    r"'(?![\p{L}_])(?:[^'\\\r\n\x02]++|\\[^\x02])*+'",
]
RUST_SKIP = "|".join(RUST_PARTS)
LUA_WORDS = "function|if|for|while|repeat|until|end"
LUA_PART = r"[\p{L}\p{Nd}_]"
LUA_SKIP = "|".join(
    [
        r"--\[\[(?:[^\]\x02]++|\](?!\]))*+(?:\]\])?+",
        r"--[^\n\x02]*+",
        r"\[\[(?:[^\]\x02]++|\](?!\]))*+(?:\]\])?+",
        quoted('"'),
        quoted("'"),
        rf"(?!(?:{LUA_WORDS})(?!{LUA_PART}))[\p{{L}}_]{LUA_PART}*+",
    ]
)

TOKENS = {
    "csharp": rf"""(?:[^/@"'{{}}{STOP}]++|{CSHARP_SKIP}|[/@])*+[{{}}{STOP}]""",
    "js": rf"""(?:[^/"'`{{}};={STOP}]++|{JS_SKIP}|/|=(?!>))*+(?:[{{}};{STOP}]|=>)""",
    "php": rf"""(?:[^/#"'\\{{}}{STOP}]++|{PHP_SKIP}|[/\\])*+[{{}}{STOP}]""",
    "rust": rf"""(?:[^/r"'(){{}}\[\]<>;{STOP}]++|{RUST_SKIP}|[/r'])*+[(){{}}\[\]<>;{STOP}]""",
    "lua": rf"""(?:[^\p{{L}}_\-\["'{STOP}]++|{LUA_SKIP}|[\-\[])*+(?:{LUA_WORDS}|[{STOP}])""",
}

WAITING = "struct<k:int,a:int,b:int,c:int>"
OPEN = "struct<k:int,d:int>"
FOUND = "struct<k:int,e:int>"


# A Rust text up to a comment that no closed pattern of `PATTERN_LEVELS` levels matches.
_CLOSED_COMMENT = nested_block(PATTERN_LEVELS).replace(r"(?:\*/)?+", r"\*/")
_OTHER_SKIPS = "|".join(k for k in RUST_PARTS if k != nested_block(PATTERN_LEVELS))
_TO_DEEP_COMMENT = rf"""(?s)\A(?:[^/r"']++|{_CLOSED_COMMENT}|{_OTHER_SKIPS}|/(?!\*)|[r'])*+(?=/\*)"""


def comment_end(tail: Column) -> Column:
    """Length of the nested comment that `tail` starts with, by counting openers and closers; to the end if it stays open."""
    marks = F.regexp_extract_all(tail, F.lit(r"(?s)(?:[^*/]++|\*(?!/)|/(?!\*))*+(?:/\*|\*/)"), 0)

    def step(acc: Column, mark: Column) -> Column:
        off, depth = acc["off"] + F.length(mark), acc["depth"] + F.when(F.endswith(mark, F.lit("/*")), 1).otherwise(-1)
        ended = F.when((acc["end"] == 0) & (depth == 0), off).otherwise(acc["end"])
        return F.struct(off.alias("off"), depth.alias("depth"), ended.alias("end"))

    start = F.struct(*[F.lit(0).alias(n) for n in ("off", "depth", "end")])
    return F.aggregate(marks, start, step, lambda acc: F.when(acc["end"] > 0, acc["end"]).otherwise(F.length(tail)))


def shallow(text: Column) -> Column:
    """A Rust text of the same length whose comments deeper than `PATTERN_LEVELS` are blanks.

    Each has more than so many openers, which bounds the rounds; texts with fewer openers pass as they are."""
    openers = F.regexp_count(text, F.lit(r"/\*"))

    def blanked(t: Column) -> Column:
        def at(off: Column) -> Column:
            tail = F.substring(t, off + 1, F.length(t))
            rest = let(tail, lambda x: let(comment_end(x), lambda n: F.concat(F.repeat(F.lit(" "), n), F.substring(x, n + 1, F.length(x)))))
            return F.concat(F.substring(t, F.lit(1), off), rest)

        return let(F.length(F.regexp_extract(t, _TO_DEEP_COMMENT, 0)), at)

    def step(acc: Column, _: Column) -> Column:
        more = ~acc["done"] & acc["t"].rlike(_TO_DEEP_COMMENT)
        return F.struct(F.when(more, blanked(acc["t"])).otherwise(acc["t"]).alias("t"), (~more).alias("done"))

    rounds = F.sequence(F.lit(0), int_div(openers, PATTERN_LEVELS))
    start = F.struct(text.alias("t"), F.lit(False).alias("done"))
    return F.when(openers > PATTERN_LEVELS, F.aggregate(rounds, start, step, lambda acc: acc["t"])).otherwise(text)


def tokens(marked: Column, dialect: str) -> Column:
    text = let(marked, shallow) if dialect == "rust" else marked
    return F.regexp_extract_all(F.concat(text, F.lit(END)), F.lit(TOKENS[dialect]), 0)


def _waiting(k: Column, a: Column | int = 0, b: Column | int = 0, c: Column | int = 0) -> Column:
    vals = [v if isinstance(v, Column) else F.lit(v) for v in (a, b, c)]
    return F.struct(k.alias("k"), *[v.cast("int").alias(n) for v, n in zip(vals, "abc")])


def _found(k: Column, e: Column | int) -> Column:
    return F.struct(k.alias("k"), (e if isinstance(e, Column) else F.lit(e)).cast("int").alias("e"))


def _keys(entries: Column, e: Column | int) -> Column:
    return F.transform(entries, lambda w: _found(w["k"], e))


def _opened(entries: Column, depth: Column) -> Column:
    return F.transform(entries, lambda w: F.struct(w["k"].alias("k"), depth.alias("d")))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


class _Step:
    """Builds the next state of a scan from the one before."""

    def __init__(self, acc: Column, size: Column):
        self.acc, self.size = acc, size

    def __call__(self, depth=None, wait=None, open=None, out=None) -> Column:
        acc = self.acc
        return F.struct(
            (acc["off"] + self.size).alias("off"),
            (acc["depth"] if depth is None else depth).alias("depth"),
            (acc["wait"] if wait is None else wait).alias("wait"),
            (acc["open"] if open is None else open).alias("open"),
            (_none(FOUND) if out is None else out).alias("out"),
        )


def _start() -> dict[str, Column]:
    return {"off": F.lit(0), "depth": F.lit(0), "wait": _none(WAITING), "open": _none(OPEN)}


def _close(acc: Column, new: _Step, at: Column, wait: Column | None = None) -> Column:
    """One level down: everything opened at that level ends at `at` (exclusive)."""
    depth = acc["depth"] - 1
    return new(
        depth=depth,
        wait=wait,
        open=F.filter(acc["open"], lambda o: o["d"] != depth),
        out=_keys(F.filter(acc["open"], lambda o: o["d"] == depth), at),
    )


def _brace_step(acc: Column, token: Column) -> Column:
    """C# and PHP: the mark stands directly before the brace asked about."""
    size = F.length(F.replace(token, F.lit(MARK), F.lit("")))
    new, after = _Step(acc, size), acc["off"] + size
    return (
        F.when(
            F.endswith(token, F.lit("{")),
            new(
                depth=acc["depth"] + 1,
                wait=_none(WAITING),
                open=F.concat(acc["open"], _opened(acc["wait"], acc["depth"])),
            ),
        )
        .when(F.endswith(token, F.lit("}")), _close(acc, new, after))
        .when(F.endswith(token, F.lit(MARK)), new(wait=F.array(_waiting(after))))
        .otherwise(new(out=F.concat(_keys(acc["wait"], -1), _keys(acc["open"], -1))))
    )


def _js_step(acc: Column, token: Column) -> Column:
    """JavaScript: a = an arrow was seen, b = the body is an expression.

    The body starts at the first brace, or, once an arrow was seen, at the first
    other code character; an expression body ends at the next semicolon.
    """
    size = F.length(F.replace(token, F.lit(MARK), F.lit("")))
    new, after = _Step(acc, size), acc["off"] + size
    arrow = F.endswith(token, F.lit(">"))
    code = F.regexp_replace(
        F.substring(token, F.lit(1), F.length(token) - F.when(arrow, F.lit(2)).otherwise(F.lit(1))), JS_SKIP, ""
    )
    expects = F.exists(acc["wait"], lambda w: (w["a"] == 1) & (w["b"] == 0))
    wait = F.when(
        expects & (F.trim(code, F.lit(WHITE_SPACE)) != ""),
        F.transform(acc["wait"], lambda w: _waiting(w["k"], w["a"], F.greatest(w["a"], w["b"]))),
    ).otherwise(acc["wait"])
    as_expression = F.transform(wait, lambda w: _waiting(w["k"], w["a"], F.greatest(w["a"], w["b"])))
    return (
        F.when(
            F.endswith(token, F.lit("{")),
            new(
                depth=acc["depth"] + 1,
                wait=F.filter(wait, lambda w: w["b"] == 1),
                open=F.concat(acc["open"], _opened(F.filter(wait, lambda w: w["b"] == 0), acc["depth"])),
            ),
        )
        .when(F.endswith(token, F.lit("}")), _close(acc, new, after, as_expression))
        .when(
            F.endswith(token, F.lit(";")),
            new(
                wait=F.filter(wait, lambda w: (w["a"] == 0) & (w["b"] == 0)),
                out=_keys(F.filter(wait, lambda w: (w["a"] == 1) | (w["b"] == 1)), after),
            ),
        )
        .when(arrow, new(wait=F.transform(wait, lambda w: _waiting(w["k"], 1, w["b"]))))
        .when(F.endswith(token, F.lit(MARK)), new(wait=F.concat(wait, F.array(_waiting(after)))))
        .otherwise(new(out=F.concat(_keys(wait, -1), _keys(acc["open"], -1))))
    )


def _rust_step(acc: Column, token: Column) -> Column:
    """Rust: a, b, c = open parentheses, brackets and angles since the signature.

    They never go below zero; the body is the first brace where all are zero, and a
    semicolon there means that the function has no body.
    """
    size = F.length(F.replace(token, F.lit(MARK), F.lit("")))
    new, after = _Step(acc, size), acc["off"] + size

    def flat(w: Column) -> Column:
        return (w["a"] == 0) & (w["b"] == 0) & (w["c"] == 0)

    def shift(field: str, by: int) -> Column:
        return new(
            wait=F.transform(
                acc["wait"],
                lambda w: _waiting(
                    w["k"], *[F.greatest(w[n] + by, F.lit(0)) if n == field else w[n] for n in "abc"]
                ),
            )
        )

    return (
        F.when(
            F.endswith(token, F.lit("{")),
            new(
                depth=acc["depth"] + 1,
                wait=F.filter(acc["wait"], lambda w: ~flat(w)),
                open=F.concat(acc["open"], _opened(F.filter(acc["wait"], flat), acc["depth"])),
            ),
        )
        .when(F.endswith(token, F.lit("}")), _close(acc, new, after))
        .when(F.endswith(token, F.lit(MARK)), new(wait=F.concat(acc["wait"], F.array(_waiting(after)))))
        .when(
            F.endswith(token, F.lit(END)), new(out=F.concat(_keys(acc["wait"], -1), _keys(acc["open"], -1)))
        )
        .when(F.size(acc["wait"]) == 0, new())
        .when(F.endswith(token, F.lit("(")), shift("a", 1))
        .when(F.endswith(token, F.lit(")")), shift("a", -1))
        .when(F.endswith(token, F.lit("[")), shift("b", 1))
        .when(F.endswith(token, F.lit("]")), shift("b", -1))
        .when(F.endswith(token, F.lit("<")), shift("c", 1))
        .when(F.endswith(token, F.lit(">")), shift("c", -1))
        .otherwise(
            new(
                wait=F.filter(acc["wait"], lambda w: ~flat(w)),
                out=_keys(F.filter(acc["wait"], flat), -1),
            )
        )
    )


def _lua_step(acc: Column, token: Column) -> Column:
    """Lua: the last letter tells words that open a block (n f r e t) from those that end one (l d)."""
    size = F.length(F.replace(token, F.lit(MARK), F.lit("")))
    new, after = _Step(acc, size), acc["off"] + size
    return (
        F.when(
            F.endswith(token, F.lit(MARK)),
            new(open=F.concat(acc["open"], F.array(F.struct(after.alias("k"), acc["depth"].alias("d"))))),
        )
        .when(F.endswith(token, F.lit(END)), new(out=_keys(acc["open"], -1)))
        .when(F.endswith(token, F.lit("d")) | F.endswith(token, F.lit("l")), _close(acc, new, after))
        .otherwise(new(depth=acc["depth"] + 1))
    )


def _python_step(acc: Column, line: Column) -> Column:
    """Python, line by line: open = blocks whose signature ended, d = indent of their `def`.

    wait = signatures still looking for their colon: a = indent, b = bracket depth,
    c = where the block ends if no colon is ever found (-1 = not seen yet).
    """
    text = F.replace(line, F.lit(MARK), F.lit(""))
    off = acc["off"]
    solid = F.trim(text, F.lit(WHITE_SPACE)) != ""
    indent = F.length(text) - F.length(F.ltrim(text, F.lit(" \t")))
    brackets = F.regexp_replace(
        F.regexp_replace(text, "|".join([quoted("'"), quoted('"'), r"#.*+"]), ""), r"[^()\[\]{}:]", ""
    )

    def colon(w: Column) -> Column:
        """Bracket depth after this line, or null when the signature ends on it."""
        return F.aggregate(
            F.split(brackets, ""),
            w["b"],
            lambda depth, ch: F.when(depth.isNull() | ((ch == ":") & (depth == 0)), F.lit(None).cast("int"))
            .when(ch.isin("(", "[", "{"), depth + 1)
            .when(ch.isin(")", "]", "}"), depth - 1)
            .otherwise(depth),
        )

    older = F.transform(
        acc["wait"],
        lambda w: _waiting(
            w["k"], w["a"], w["b"], F.when((w["c"] < 0) & solid & (indent <= w["a"]), off).otherwise(w["c"])
        ),
    )
    here = F.when(F.startswith(line, F.lit(MARK)), F.array(_waiting(off, indent, 0, -1))).otherwise(_none(WAITING))
    seen = F.transform(F.concat(older, here), lambda w: _waiting(w["k"], w["a"], colon(w), w["c"]))
    new = _Step(acc, F.length(text) + 1)
    ended = F.when(solid, F.filter(acc["open"], lambda o: o["d"] >= indent)).otherwise(_none(OPEN))
    kept = F.when(solid, F.filter(acc["open"], lambda o: o["d"] < indent)).otherwise(acc["open"])
    total = off - 1
    return (
        F.when(
            line == END,
            new(
                out=F.concat(
                    _keys(acc["open"], total),
                    F.transform(
                        acc["wait"], lambda w: _found(w["k"], F.when(w["c"] < 0, total).otherwise(w["c"]))
                    ),
                )
            ),
        )
        .when(
            (F.size(acc["wait"]) == 0) & ~F.startswith(line, F.lit(MARK)), new(open=kept, out=_keys(ended, off))
        )
        .otherwise(
            new(
                wait=F.filter(seen, lambda w: w["b"].isNotNull()),
                open=F.concat(
                    kept,
                    F.transform(
                        F.filter(seen, lambda w: w["b"].isNull()),
                        lambda w: F.struct(w["k"].alias("k"), w["a"].alias("d")),
                    ),
                ),
                out=_keys(ended, off),
            )
        )
    )


STEPS: dict[str, Callable[[Column, Column], Column]] = {
    "csharp": _brace_step,
    "js": _js_step,
    "php": _brace_step,
    "rust": _rust_step,
    "lua": _lua_step,
    "python": _python_step,
}


def pieces(marked: Column, dialect: str) -> Column:
    """What the scan of a dialect reads: lines for Python, tokens otherwise."""
    if dialect == "python":
        return F.concat(F.split(marked, "\n", -1), F.array(F.lit(END)))
    return tokens(marked, dialect)


def end_by_scan(text: Column, k: Column, dialect: str) -> Column:
    """End (exclusive) of the block asked about at k, lexing from there on; -1 = none."""
    rest = F.concat(F.lit(MARK), F.substring(text, k + 1, F.length(text)))
    return F.aggregate(
        scan(pieces(rest, dialect), _start(), FOUND, STEPS[dialect], chunk=None),
        F.lit(-1),
        lambda acc, f: F.when((f["k"] == 0) & (f["e"] >= 0), f["e"] + k).otherwise(acc),
    )


def rust_body_by_scan(tail: Column, k: Column) -> Column:
    """Where the body of the signature at k opens, from the text after it; -1 = none.

    `at` is -2 until a brace or a semicolon stands outside of all brackets.
    """

    def step(acc: Column, token: Column) -> Column:
        mark, off = F.right(token, F.lit(1)), acc["off"] + F.length(token)

        def level(name: str, opener: str, closer: str) -> Column:
            by = F.when(mark == opener, 1).when(mark == closer, -1).otherwise(0)
            return F.greatest(acc[name] + by, F.lit(0)).alias(name)

        flat = (acc["a"] == 0) & (acc["b"] == 0) & (acc["c"] == 0)
        at = F.when((acc["at"] > -2) | ~flat, acc["at"]).when(mark == "{", k + off - 1).when(mark == ";", F.lit(-1)).otherwise(F.lit(-2))
        return F.struct(off.alias("off"), level("a", "(", ")"), level("b", "[", "]"), level("c", "<", ">"), at.alias("at"))

    start = F.struct(*[F.lit(0).alias(n) for n in ("off", "a", "b", "c")], F.lit(-2).alias("at"))
    return F.aggregate(tokens(tail, "rust"), start, step, lambda acc: F.greatest(acc["at"], F.lit(-1)))

"""Where a function ends: one regular expression per signature.

Balanced brackets are written as possessive patterns unrolled to a fixed depth, so
that matching is one linear pass without backtracking, in the JVM's own regex
engine. A pattern is tried on the text up to the next signature, then on a window. What
that leaves open in a file is answered together by one pass over it (`closers`), and
the rest on all the text that follows: by the pattern, then by the exact scan in `lexing`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.rowscan import let
from repoloom.operators import closers
from repoloom.operators.lexing import LUA_PART, LUA_WORDS, end_by_scan, rust_body_by_scan

DEPTH = 30
WINDOW = 3000


def _nest(opener: str, gap: str, closer: str, depth: int = DEPTH) -> str:
    block = rf"{opener}(?:{gap})*+{closer}"
    for _ in range(depth):
        block = rf"{opener}(?:{gap}|{block})*+{closer}"
    return block


def _text(q: str, lenient: bool) -> str:
    """A quoted string; lenient = it may also run to the end of the text."""
    return rf"{q}(?:[^{q}\\]++|\\.)*+" + (rf"(?:{q}|\\?\z)" if lenient else q)


def _until(opener: str, body: str, closer: str, lenient: bool) -> str:
    return rf"{opener}(?:{body})*+" + (rf"(?:{closer}|\z)" if lenient else closer)


def _block_comment(lenient: bool) -> str:
    return _until(r"/\*", r"[^*]++|\*(?!/)", r"\*/", lenient)


def _rust_comment(lenient: bool) -> str:
    flat = r"[^*/]++|\*(?!/)|/(?!\*)"
    inner = _until(r"/\*", flat, r"\*/", lenient)
    for _ in range(3):
        inner = _until(r"/\*", rf"{flat}|{inner}", r"\*/", lenient)
    return inner


def _raw_strings(lenient: bool) -> str:
    kinds = [_until('r"', '[^"]++', '"', lenient)]
    kinds += [_until(rf'r{"#" * n}"', rf'[^"]++|"(?!{"#" * n})', rf'"{"#" * n}', lenient) for n in range(1, 5)]
    return "|".join(kinds)


def skips(dialect: str, lenient: bool = False) -> str:
    """Strings and comments of a dialect."""
    slash, double, single = r"//[^\n]*+", _text('"', lenient), _text("'", lenient)
    long_lua = _until(r"\[\[", r"[^\]]++|\](?!\])", r"\]\]", lenient)
    return "|".join(
        {
            "csharp": [slash, _block_comment(lenient), _until('@"', '[^"]++|""', '"', lenient), double, single],
            "js": [slash, _block_comment(lenient), double, single, _text("`", lenient)],
            "php": [slash, r"#[^\n]*+", _block_comment(lenient), r"\\[\\\"']", double, single],
            "rust": [
                slash,
                _rust_comment(lenient),
                _raw_strings(lenient),
                double,
                r"'(?![\p{L}_])(?:[^'\\\r\n]++|\\.)*+'",
            ],
            "lua": ["--" + long_lua, r"--(?!\[\[)[^\n]*+", long_lua, double, single],
        }[dialect]
    )


# What may stand between the tokens that count, besides strings and comments: plain
# text of each dialect, given the further characters that count.
PLAIN = {
    "csharp": r"""[^/@"'{}%s]++|/(?![/*])|@(?!")""",
    "js": r"""[^/"'`{}%s]++|/(?![/*])""",
    "php": r"""[^/#"'\\{}%s]++|/(?![/*])|\\(?![\\"'])""",
    "rust": r"""[^/r"'{}%s]++|/(?![/*])|r(?!#*+")|'(?:(?=[\p{L}_])|(?!(?:[^'\\\r\n]++|\\.)*+'))""",
}


def _gap(dialect: str, extra: str = "", lenient: bool = False) -> str:
    return PLAIN[dialect].replace("%s", extra) + "|" + skips(dialect, lenient)


def _braces(dialect: str) -> str:
    return _nest(r"\{", _gap(dialect), r"\}")


def _no_end(dialect: str, prefix: str = "") -> str:
    """The block asked about stays open up to the end of the text."""
    return rf"(?s)\A{prefix}(?:\{{(?:{_gap(dialect, lenient=True)}|{_braces(dialect)})*+)++\z"


def _js_patterns() -> tuple[str, str, str]:
    """Signature, then a block, or an arrow and a block or an expression up to `;`; last, up to where the body opens."""
    block, skip = _braces("js"), skips("js")
    before = r"""[^/"'`{=]++|/(?![/*])|=(?!>)|""" + skip
    after_arrow = rf"=>(?:(?U:\s)++|{skip}|=>)*+"
    expression = r"""(?!\{)(?:[^/"'`;]++|/(?![/*])|%s)*+;""" % skip
    found = rf"(?s)\A(?:{before})*+(?:{block}|{after_arrow}(?:{block}|{expression}))"
    return found, _no_end("js", rf"(?:{before})*+(?:{after_arrow})?+"), rf"(?s)\A(?:{before})*+(?:\{{|{after_arrow}.)"


def _rust_header() -> str:
    """Text before a body in which (), [] and <> nest properly; `->` counts as a closing angle."""
    extra = r"()\[\]<>;"
    outer, inner = _gap("rust", extra) + r"|>", _gap("rust", extra)
    inside = r"[{};]"
    a = rf"<(?:{inner}|{inside})*+>"
    p1, k1 = rf"\((?:{inner}|{inside})*+\)", rf"\[(?:{inner}|{inside})*+\]"
    for _ in range(2):
        a, p1, k1 = (
            rf"<(?:{inner}|{inside}|{p1}|{k1}|{a})*+>",
            rf"\((?:{inner}|{inside}|{p1}|{k1}|{a})*+\)",
            rf"\[(?:{inner}|{inside}|{p1}|{k1}|{a})*+\]",
        )
    p, k = rf"\((?:{outer}|{inside}|{a})*+\)", rf"\[(?:{outer}|{inside}|{a})*+\]"
    for _ in range(2):
        p, k = (
            rf"\((?:{outer}|{inside}|{p}|{k}|{a})*+\)",
            rf"\[(?:{outer}|{inside}|{p}|{k}|{a})*+\]",
        )
    # A stray closer at level zero is ignored; the body comes at the first `{`.
    return rf"(?:{outer}|{p}|{k}|{a}|\)|\])*+"


def _lua_patterns() -> tuple[str, str]:
    word = rf"(?!(?:{LUA_WORDS})(?!{LUA_PART}))[\p{{L}}_]{LUA_PART}*+"
    plain = r"""[^\p{L}_\-\["']++|-(?!-)|\[(?!\[)|""" + word
    gap, lenient = f"{plain}|{skips('lua')}", f"{plain}|{skips('lua', True)}"
    opener = rf"(?:function|if|for|while|repeat)(?!{LUA_PART})"
    block = _nest(opener, gap, rf"(?:end|until)(?!{LUA_PART})", 20)
    return rf"(?s)\A(?:{gap})*+{block}", rf"(?s)\A(?:{gap})*+(?:{opener}(?:{lenient}|{block})*+)++\z"


def _python_header() -> str:
    """Signature up to the end of the line that holds its colon."""
    q = "|".join(rf"{c}(?:[^{c}\\\n]++|\\[^\n])*+(?:{c}|\\?(?=\n|\z))" for c in "'\"")
    skip = rf"{q}|#[^\n]*+"
    nest = _nest(r"[(\[{]", rf"""[^()\[\]{{}}"'#]++|{skip}""", r"[)\]}]", 10)
    return rf"""(?s)\A(?:[^()\[\]{{}}:"'#]++|{skip}|{nest})*+:[^\n]*+(?:\n|\z)"""


BLOCK = {d: (rf"(?s)\A{_braces(d)}", _no_end(d)) for d in ("csharp", "php")}
*_js_block, JS_BODY = _js_patterns()
BLOCK["js"] = tuple(_js_block)
BLOCK["rust"] = (rf"(?s)\A{_rust_header()}{_braces('rust')}", _no_end("rust", _rust_header()))
BLOCK["lua"] = _lua_patterns()
RUST_BODY = rf"(?s)\A{_rust_header()}\{{"
RUST_NO_BODY = rf"(?s)\A{_rust_header()};"
PYTHON_HEADER = _python_header()


def _tail(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


UNDECIDED = -3


def _matched(piece: Column, s: Column, dialect: str, otherwise: Column) -> Column:
    n = F.length(F.regexp_extract(piece, BLOCK[dialect][0], 0))
    return let(n, lambda n: F.when(n > 0, s["brace"] + n).otherwise(otherwise))


def near_end(text: Column, s: Column, dialect: str, otherwise: Column) -> Column:
    """End of the function if its own text, or a window from its block on, decides it."""
    own = _tail(s["piece"], s["brace"] - s["idx"])
    # Functions around others: a window usually holds them. It ends with a line, which no
    # word and no quoted character crosses.
    window = F.regexp_extract(F.substring(text, s["brace"] + 1, F.lit(WINDOW)), r"(?s)\A.*\n", 0)
    rest = F.when(F.length(s["piece"]) < WINDOW, _matched(window, s, dialect, otherwise)).otherwise(otherwise)
    if dialect == "rust":
        rest = F.when(own.rlike(RUST_NO_BODY), F.lit(-1)).otherwise(rest)
    if dialect == "js":  # no window for an expression that goes on: without semicolons that is every one
        rest = F.when(own.rlike(FAR_PATTERNS["js"]["expression"]), otherwise).otherwise(rest)
    return _matched(own, s, dialect, rest)


def far_end(text: Column, s: Column, dialect: str) -> Column:
    """End of the function from all the text that follows."""
    scanned = end_by_scan(text, s["brace"], dialect)
    return let(
        _tail(text, s["brace"]),
        lambda tail: _matched(tail, s, dialect, F.when(tail.rlike(BLOCK[dialect][1]), F.lit(-1)).otherwise(scanned)),
    )


def block_end(text: Column, s: Column, dialect: str) -> Column:
    """End (exclusive) of the function with signature `s`; -1 when it has none."""
    if dialect == "python":
        return _python_end(text, s)
    return near_end(text, s, dialect, far_end(text, s, dialect))


RULES = {
    "csharp": ("csharp_method", "csharp_type"),
    "js": ("js_function", "js_arrow", "js_method"),
    "php": ("php",),
    "rust": ("rust",),
    "lua": ("lua_named", "lua_assigned"),
}


def _closed(dialect: str) -> str:
    """A text that ends outside strings and comments. A backslash before its last line feed may
    belong to a character literal that goes on."""
    if dialect == "lua":
        word = rf"[\p{{L}}_]{LUA_PART}*+"
        return rf"""(?s)\A(?:[^\p{{L}}_\-\["']++|-(?!-)|\[(?!\[)|{word}|{skips("lua")})*+\z"""
    return rf"(?s)\A(?!.*\\\n\z)(?:{_gap(dialect)}|[{{}}])*+\z"


def _far_patterns(dialect: str) -> dict[str, str]:
    found = {"closed": _closed(dialect), "opening": "", "expression": ""}
    if dialect == "js":
        skip = skips("js")
        before = r"""[^/"'`{=]++|/(?![/*])|=(?!>)|""" + skip
        after_arrow = rf"=>(?:(?U:\s)++|{skip}|=>)*+"
        found["opening"] = rf"(?s)\A(?:{before})*+(?:{after_arrow})?+(?=\{{)"
        found["expression"] = rf"""(?s)\A(?:{before})*+{after_arrow}(?!\{{)(?:[^/"'`;]++|/(?![/*])|{skip})*+\z"""
    if dialect == "rust":
        found["opening"] = rf"(?s)\A{_rust_header()}(?=\{{)"
    return found


FAR_PATTERNS = {d: _far_patterns(d) for d in RULES}


def block_ends(text: Column, sigs: Column, dialect: str) -> Column:
    """`block_end` of every signature of a file, in time that follows the text."""
    if dialect == "python":
        return F.transform(sigs, lambda s: _python_end(text, s))

    def completed(near: Column) -> Column:
        want = F.transform(near, lambda e: e == UNDECIDED)
        far = closers.ends(text, sigs, want, dialect, RULES[dialect], FAR_PATTERNS[dialect])

        def chosen(found: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                e, f = F.get(near, i), F.get(found, i)
                return F.when(e != UNDECIDED, e).when(f != closers.UNKNOWN, f).otherwise(far_end(text, s, dialect))

            return F.transform(sigs, one)

        return F.when(F.exists(near, lambda e: e == UNDECIDED), let(far, chosen)).otherwise(near)

    return let(F.transform(sigs, lambda s: near_end(text, s, dialect, F.lit(UNDECIDED))), completed)


def body_start(text: Column, s: Column, dialect: str) -> Column:
    """Where the body of signature `s` opens (C#, PHP, JavaScript, Rust); -1 when it has none.

    JavaScript: the first brace, or what follows the arrow. Rust: the first brace outside of
    brackets. The text up to the next signature is tried first, then all that follows.
    """
    at = s["brace"]
    if dialect not in ("js", "rust"):
        return at

    def opened(piece: Column, otherwise: Column) -> Column:
        pattern = JS_BODY if dialect == "js" else RUST_BODY
        return let(
            F.length(F.regexp_extract(piece, pattern, 0)),
            lambda n: F.when(n > 0, at + n - 1).otherwise(otherwise),
        )

    if dialect == "js":
        return opened(s["piece"], let(_tail(text, at), lambda tail: opened(tail, F.lit(-1))))
    rest = let(_tail(text, at), lambda tail: opened(tail, rust_body_by_scan(tail, at)))
    return opened(s["piece"], F.when(s["piece"].rlike(RUST_NO_BODY), F.lit(-1)).otherwise(rest))


def _python_end(text: Column, s: Column) -> Column:
    """The block runs up to the first line that is not blank and not indented deeper than `def`."""

    def size(piece: Column) -> Column:
        """Length of signature and body in `piece`, 0 when the signature is not decided."""
        indent = F.length(piece) - F.length(F.ltrim(piece, F.lit(" \t")))
        line = F.concat(
            F.lit(r"\A(?:(?!\z)(?:[ \t]{"),
            (indent + 1).cast("string"),
            F.lit(r"}[^\n]*+|(?U)[\s&&[^\n]]*+)(?:\n|\z))*+"),
        )
        return let(
            F.length(F.regexp_extract(piece, PYTHON_HEADER, 0)),
            lambda n: F.when(n == 0, F.lit(0)).otherwise(
                n + F.length(F.call_function("regexp_extract", _tail(piece, n), line, F.lit(0)))
            ),
        )

    at = s["idx"]
    on_tail = let(
        size(_tail(text, at)),
        lambda n: F.when(n > 0, at + n).otherwise(end_by_scan(text, at, "python")),
    )

    def within(piece: Column, otherwise: Column) -> Column:
        """Decided when the line that ends the block lies in the piece."""
        return let(
            piece,
            lambda p: let(size(p), lambda n: F.when((n > 0) & (n < F.length(p)), at + n).otherwise(otherwise)),
        )

    return within(s["piece"], within(F.substring(text, at + 1, F.lit(WINDOW)), on_tail))

"""Function spans: golden rows, edge cases, and the fast path against the exact scan."""

import random

import pytest
from pyspark.sql import functions as F

from repoloom.operators import signatures as sg
from repoloom.operators.blocks import block_end, body_start
from repoloom.operators.lexing import end_by_scan
from repoloom.plans import functions as fn
from workload import queries as q

GOLDEN = {
    "src/Parts/Part0.cs": [("Area", 66, 167), ("Name", 169, 246), ("struct P0", 251, 280)],
    "web/app1.js": [("run1", 0, 94), ("inner", 34, 73), ("sq1", 95, 120), ("go", 131, 165)],
    "java/P2.java": [("area", 18, 71), ("log2", 71, 112)],
    "py/mod3.py": [("outer3", 11, 123), ("inner", 55, 102), ("tail3", 123, 151)],
    "lua/m4.lua": [("M.f4", 13, 112), ("M.g", 113, 143)],
    "php/c5.php": [("make5", 17, 95)],
    "rs/l6.rs": [("f6", 0, 108)],
}


def test_golden(spark, sf):
    rows = q.QUERIES["fn_spans"](spark, sf).filter(F.col("path").isin(*GOLDEN)).orderBy("path", "emit_pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"], []).append((r["name"], r["start_pos"], r["end_pos"]))
    assert got == GOLDEN


def spans(spark, language, text):
    units = spark.createDataFrame([("r", "b", "p", language, text)], "repo string, branch string, path string, language string, text string")
    return [(r["name"], text[r["start"] : r["end"]]) for r in fn.function_spans(units).orderBy("emit_pos").collect()]


CASES = [
    # A match may start on a blank line; a Java call becomes a span.
    ("java", "class A {\n\n  int f(int a) {\n    return foo(a);\n  }\n}", [("f", "\n  int f(int a) {\n"), ("foo", "    return foo(a);\n  }\n}")]),
    # A column-0 Java method without modifier needs a blank line above.
    ("java", "int f() {}\n", []),
    # Destructured parameters: the body starts at the parameter's brace.
    ("javascript", "function f({a}) { return a; }", [("f", "function f({a}")]),
    # An arrow without a semicolon after it has no end.
    ("javascript", "const f = x => x\n", []),
    ("javascript", "const f = x => /* } */ { y; }\n;", [("f", "const f = x => /* } */ { y; }")]),
    ("typescript", "@dec()\nclass A {\n  // c\n\n  go() { `}`; }\n}", [("go", "  // c\n\n  go() { `}`; }")]),
    # A plain `do … end` ends a Lua span early.
    ("lua", "function f()\n do x() end\n y()\nend", [("f", "function f()\n do x() end")]),
    ("lua", "local s = [[\nfunction f() return 1 end\n]]\n", [("f", "function f() return 1 end")]),
    # Keywords are skipped ignoring case; `new Foo() {` is reported; expression bodies are not.
    ("csharp", "  If (a) { }\n  new Foo() { x };\n  int A() => 1;\n", [("Foo", "  new Foo() { x }")]),
    ("csharp", "[A]\n\nint F() { return '}' == @\"\"\"}\"[0]; }", [("F", "[A]\n\nint F() { return '}' == @\"\"\"}\"[0]; }")]),
    # Walking up into a block comment whose start is an include line.
    ("csharp", "x;\n/* a\n b */\nvoid F() { }", [("F", "/* a\n b */\nvoid F() { }")]),
    # PHP keeps blank lines above; an escaped quote outside a string opens nothing.
    ("php", "<?php\n\n# c\nfunction f() { $a = \\'; }", [("f", "\n# c\nfunction f() { $a = \\'; }")]),
    # Comments at the level of `def` end the block, deeper ones do not; the colon may come lines later.
    ("python", "def f(\n a={1: 2},\n):\n  x\n  # in\n# out\n", [("f", "def f(\n a={1: 2},\n):\n  x\n  # in\n")]),
    ("python", "def f(\n x\n y\nz\n", [("f", "def f(\n x\n y\n")]),
    ("python", "def f(a='(:'): pass\n\n\tx\ny", [("f", "def f(a='(:'): pass\n\n\tx\n")]),
    # Rust: no body; nested comments; raw strings; a quoted letter is a lifetime.
    ("rust", "fn a();\nfn b() -> Vec<u8> { r#\"}\"# /* /* } */ } */ }", [("b", "fn b() -> Vec<u8> { r#\"}\"# /* /* } */ } */ }")]),
    ("rust", "fn f(x: [u8; {3}]) where T: A<{ 1 }> { 'a'; }", [("f", "fn f(x: [u8; {3}]) where T: A<{ 1 }> { 'a'; }")]),
    ("rust", "fn f<F: Fn(A) -> B>(f: F) { }", [("f", "fn f<F: Fn(A) -> B>(f: F) { }")]),
    ("go", "func f() { }", []),
    ("javascript", "function f() { " + "{" * 40 + "}" * 40 + " }", [("f", "function f() { " + "{" * 40 + "}" * 40 + " }")]),
    ("javascript", "function f() { {", []),
    ("csharp", "// x\n" * 400 + "int F() { }", [("F", "// x\n" * 400 + "int F() { }")]),
    ("php", "a\x01b\x02\nfunction f() { '\x03'; }", [("f", "function f() { '\x03'; }")]),
]


def test_cases(spark):
    units = spark.createDataFrame(
        [("r", "b", str(i), lang, text) for i, (lang, text, _) in enumerate(CASES)],
        "repo string, branch string, path string, language string, text string",
    )
    got = {}
    for r in fn.function_spans(units).orderBy("emit_pos").collect():
        text = CASES[int(r["path"])][1]
        got.setdefault(int(r["path"]), []).append((r["name"], text[r["start"] : r["end"]]))
    for i, (lang, text, expected) in enumerate(CASES):
        assert got.get(i, []) == expected, (lang, text)


FRAGMENTS = {
    "csharp": ["int F() {", "class A {", "}", '"a}"', "'}'", "// }\n", "/* { */", '@"}""{"', "\n", " ", "x;", "'", '"', "\\", "/*", "(a)", "=>"],
    "js": ["function f() {", "const g = x =>", "h(a) {", "}", "{", ";", "`}`", "'{'", "=> ", "// {\n", "/* ; */", "\n", " ", "x", '"', "\\", "="],
    "php": ["function f() {", "function g($a = '{') {", "}", "# }\n", "\\'", "\\\\'", "'", '"', "// {\n", "/*", "*/", "\n", " ", "{"],
    "rust": ["fn f() {", "fn g<T>(x: [u8; 3]) -> B {", "fn h();", "}", "'a", "'{'", "'\\''", "/* /* } */", "*/", 'r#"}"#', 'r"{"', "<", ">", "->", "(", ")", "\n", " ", "[", "]", "{", ";"],
    "lua": ["function f()", "g = function(", "if", "do", "end", "until", "repeat", "for", "--[[ end ]]", "-- end\n", "[[end]]", '"end"', "3end", "endx", "\n", " ", "'", "["],
    "python": ["def f(a):", "def g(\n", "  def h(x,", "async def k():", ":", "(", ")", "]", "{", "'", '"', "# :", "\\", "\n", "\n  ", "\n    x", "\n\n", " y"],
}


@pytest.mark.parametrize("dialect", sorted(FRAGMENTS))
def test_fast_path_equals_scan(spark, dialect):
    rnd = random.Random(7)
    texts = ["\n".join("".join(rnd.choices(FRAGMENTS[dialect], k=rnd.randint(3, 14))) for _ in range(4)) for _ in range(250)]
    language = {v: k for k, v in fn.DIALECTS.items() if k != "typescript"}[dialect]
    units = spark.createDataFrame(
        [("r", "b", str(i), language, t) for i, t in enumerate(texts)],
        "repo string, branch string, path string, language string, text string",
    )
    sigs = fn.signatures(units).select("path", "lex_text", F.inline("sigs"))
    s = F.struct("idx", "brace", "piece", "above")
    got = sigs.select(
        "lex_text", "idx", block_end(F.col("lex_text"), s, dialect).alias("fast"), end_by_scan(F.col("lex_text"), F.col("brace"), dialect).alias("exact")
    ).collect()
    assert len(got) > 100
    assert [r for r in got if r["fast"] != r["exact"]] == []


# The forms that the reduced patterns must agree with.
PLAIN = {
    "java": r"^\s*(?:public|private|protected|static|final|synchronized|abstract|native|\s)+\s*(?:[\w<>\[\], ?\.]+)\s+([A-Za-z_]\w*)\s*\(",
    "csharp_method": r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|new|partial|async)\s+)*(?:[\w<>\[\],\s\?]+\s+)?([@\w]+)\s*\([^;{]*\)\s*\{",
}


@pytest.mark.parametrize("rule", sorted(PLAIN))
def test_reduced_patterns(spark, rule):
    rnd = random.Random(3)
    words = ["public", "static", "final", "int", "List<A, B>", "foo", "@x", "bar", "[A]", "[B(1)]", " ", "  ", "\t", "\n", "\n\n", "(", "()", ") {", "{", ";", ".", "?"]
    texts = ["".join(rnd.choices(words, k=rnd.randint(2, 16))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [F.regexp_extract_all("t", F.lit(sg.FLAGS + p), F.lit(g)).alias(n) for g in (0, 1) for n, p in ((f"a{g}", PLAIN[rule]), (f"b{g}", sg.PATTERNS[rule][0]))]
    rows = df.select("t", *found).collect()
    assert sum(bool(r["a0"]) for r in rows) > 60
    assert [r["t"] for r in rows if r["a0"] != r["b0"] or r["a1"] != r["b1"]] == []


def test_one_pass_without_shuffle(spark, sf):
    """Spans come from one scan: no exchange, and each stage is computed once."""
    df = fn.function_spans(q.code_units(spark, sf))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert plan.count("FileScan parquet") == 1


BODIES = [
    ("javascript", "function f({a}) { return a; }", [11]),
    ("javascript", "const f = x => /* } */ { y; }\n;", [23]),
    ("javascript", "const f = x => x\n", [15]),
    ("javascript", "function f(a) // {\n", [-1]),
    ("javascript", "function f(a, /*\nfunction g(b) {\n*/ c) {}", [39, 31]),
    ("rust", "fn f(a: [u8; 2]) -> Vec<{1}> { }", [29]),
    ("rust", "fn f();\nfn g() {}", [-1, 15]),
    ("rust", "fn f(a: ((((((((u8;)))))))), '{') /* { */ {}", [42]),
    ("php", "<?php\nfunction f($a) { }", [21]),
]


@pytest.mark.parametrize("language, text, expected", BODIES)
def test_body_start(spark, language, text, expected):
    units = spark.createDataFrame([("r", "b", "p", language, text)], "repo string, branch string, path string, language string, text string")
    dialect = {"javascript": "js"}.get(language, language)
    df = fn.signatures(units).select("lex_text", F.explode("sigs").alias("s"))
    rows = df.select(F.col("s.idx"), body_start(F.col("lex_text"), F.col("s"), dialect).alias("at")).orderBy("idx").collect()
    assert [r["at"] for r in rows] == expected


@pytest.mark.parametrize("levels", [5, 9, 33, 1000])
def test_comments_nest_without_limit(spark, levels):
    deep = "/* \" { " * levels + " } ' " + "*/ " * levels
    text = f"fn f(a: u8 {deep}) {{ {deep} let s = \"/*\"; }}\n{deep}\nfn g() {{ x(); }}\nfn h() {{ /* {deep}"
    body = text.index("{ " + deep)
    assert spans(spark, "rust", text)[0][1] == text[: text.index("}\n") + 1]
    assert [n for n, _ in spans(spark, "rust", text)] == ["f", "g"]
    units = spark.createDataFrame([("r", "b", "p", "rust", text)], "repo string, branch string, path string, language string, text string")
    df = fn.signatures(units).select("lex_text", F.explode("sigs").alias("s"))
    starts = df.select("s.idx", body_start(F.col("lex_text"), F.col("s"), "rust").alias("at")).orderBy("idx").collect()
    assert [r["at"] for r in starts] == [body, text.index("{ x()"), text.rindex("h() {") + 4]
    from repoloom.operators.tokens import code_tokens

    braces = [r["off"] for r in code_tokens(units).filter("token in ('{', '}')").orderBy("off").collect()]
    assert braces == [body, text.index("}\n"), text.index("{ x()"), text.index("; }\nfn h") + 2, text.rindex("h() {") + 4]


@pytest.mark.parametrize("dialect", sorted(set(FRAGMENTS) - {"python"}))
def test_one_pass_equals_scan(spark, dialect, monkeypatch):
    """What the pass from the last signature to the first tells is what the scan of each signature finds."""
    from repoloom.operators import blocks, closers

    rnd = random.Random(11)
    balanced = {"lua": ["if a then end\n", "for i = 1, 2 do end\n", "end\n"]}.get(dialect, ["{ x; }\n", "}\n", "{\n", "y\n"])
    kinds = [FRAGMENTS[dialect] + ["\n"] * 8, FRAGMENTS[dialect][:3] + balanced * 3 + ["\n"] * 6]
    texts = ["\n".join("".join(rnd.choices(kinds[i % 2], k=rnd.randint(3, 14))) for _ in range(6)) for i in range(300)]
    language = {v: k for k, v in fn.DIALECTS.items() if k != "typescript"}[dialect]
    units = spark.createDataFrame(
        [("r", "b", str(i), language, t) for i, t in enumerate(texts)],
        "repo string, branch string, path string, language string, text string",
    )
    text, sigs = F.col("lex_text"), F.col("sigs")
    all_asked = F.transform(sigs, lambda s: F.lit(True))
    told = closers.ends(text, sigs, all_asked, dialect, blocks.RULES[dialect], blocks.FAR_PATTERNS[dialect])
    df = fn.signatures(units)
    df = df.select("path", "lex_text", "sigs", told.alias("told"), blocks.block_ends(text, sigs, dialect).alias("ends"))
    df = df.select("path", "lex_text", F.expr("inline(arrays_zip(sigs, told, ends))"))
    got = df.select("path", "lex_text", "sigs.idx", "told", "ends", end_by_scan(text, F.col("sigs.brace"), dialect).alias("exact")).collect()
    assert [r for r in got if r["told"] != closers.UNKNOWN and r["told"] != r["exact"]] == []
    assert [r for r in got if r["ends"] != r["exact"]] == []
    assert sum(r["told"] != closers.UNKNOWN for r in got) > len(got) / 4


def test_time_follows_the_text(spark):
    """Arrows without semicolons, and functions around others: four times the text, not sixteen times the time."""
    import time

    def seconds(n):
        text = "".join(f"const f{i} = (x) => x * 2\n" for i in range(n)) + "".join(f"function g{i}() {{\n" for i in range(n // 40)) + "}\n" * (n // 40)
        units = spark.createDataFrame([("r", "b", "p", "javascript", text)], "repo string, branch string, path string, language string, text string")
        df = fn.function_spans(units)
        df._jdf.queryExecution().executedPlan()
        start = time.perf_counter()
        assert df.count() == n // 40  # no arrow has an end
        return time.perf_counter() - start

    seconds(500)
    assert seconds(12_000) < 8 * max(seconds(3000), 0.5)

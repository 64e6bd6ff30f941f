"""Registered queries: one per operator, over the given tables or views of them."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import charset as cs
from repoloom.functions import lookups as lk
from repoloom.functions import paths as fp
from repoloom.functions import text as ft
from repoloom.functions.rowscan import fenced
from repoloom.operators import classify, ordering, outline, selection, tokens, tree
from repoloom.operators import signatures as sg
from repoloom.operators.blocks import block_ends, body_start
from repoloom.plans import document as doc
from repoloom.plans import functions as fn
from repoloom.session import ensure_checkpoint_dir, pinned
from repoloom.sources import checkouts, listing, responses, writers
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STAMP = datetime.datetime(2024, 5, 6, 7, 8, 9)
API = "https://git.example.org/api"


def query(fun: Query) -> Query:
    QUERIES[fun.__name__] = fun
    return fun


def long(name: str, alias: str | None = None):
    return F.col(name).cast("bigint").alias(alias or name)


def repo_bytes(spark, sf):
    """Files of `repo_files` with their text as bytes."""
    return views.repo_files(spark, sf).withColumn("content", F.encode("content", "UTF-8"))


def classed(spark, sf):
    return classify.with_classes(views.repo_files(spark, sf).select("doc_id", "repo", "path"))


def repo_inventory(spark, sf):
    """Inventory of `repo_files` in which some files have no readable bytes."""
    files = repo_bytes(spark, sf).withColumn("content", F.when(F.col("doc_id") % 7 != 0, F.col("content")))
    return classify.inventory(files, large_bytes=1000)


def code_units(spark, sf):
    files = views.code_files(spark, sf)
    return doc.file_units(files.select("repo", "branch", "path", F.encode("content", "UTF-8").alias("content")))


def code_sigs(spark, sf, *rules):
    """Signatures of the code files found by the given rules."""
    df = fn.signatures(code_units(spark, sf)).select("path", "text", F.inline("sigs"))
    return df.filter(F.col("rule").isin(*rules))


def signature_query(*rules):
    def run(spark, sf):
        return code_sigs(spark, sf, *rules).select("path", "rule", "name", long("idx"))

    return run


for _id, _rules in {
    "sig_csharp_method": ["csharp_method"],
    "sig_js_function": ["js_function"],
    "sig_js_arrow": ["js_arrow"],
    "sig_js_method": ["js_method"],
    "sig_java": ["java"],
    "sig_python": ["python"],
    "sig_lua_named": ["lua_named"],
    "sig_lua_assigned": ["lua_assigned"],
    "sig_php": ["php"],
    "sig_rust": ["rust"],
}.items():
    QUERIES[_id] = signature_query(*_rules)


@query
def sig_csharp_type(spark, sf):
    """Braced C# types and which of them are leaves."""
    df = fn.all_spans(code_units(spark, sf)).filter(F.col("dialect") == "csharp")
    leaves = F.transform(fn.leaf_types(F.col("raw_spans")), lambda t: t["start"])
    df = df.withColumn("leaves", leaves).select("path", "leaves", F.inline(F.filter("raw_spans", fn.is_type)))
    return df.select(
        "path", "name", long("start", "start_pos"), long("end", "end_pos"),
        F.array_contains("leaves", F.col("start")).alias("is_leaf"),
    )


# ---------------------------------------------------------------- sources and sinks


@query
def src_files_checkout(spark, sf):
    """Store documents as files, some outside of the layout, and read them back as checkouts: their lines and errors."""
    docs = views.table(spark, sf, "documents")
    home = f"{ensure_checkpoint_dir(spark)}/checkouts-{uuid.uuid4().hex}"
    inside = F.col("doc_id") % 50 != 0
    docs.filter(inside).select("source", "lang", "text").write.partitionBy("source", "lang").text(f"{home}/kept")
    docs.filter(~inside).select("source", "text").write.partitionBy("source").text(f"{home}/kept/elsewhere")
    files = checkouts.read_checkouts(spark, f"{home}/kept", r"source=([^/]+)/lang=([^/]+)/(part-[^/]+)")
    folder = F.regexp_replace("path", r"(\A|/)(part-|_)[^/]*\z", "")
    lines = F.split(cs.utf8_lenient(F.expr("substring(content, 1, length(content) - 1)")), "\n", -1)
    rows = files.filter(~F.col("path").rlike(r"_SUCCESS\z"))
    rows = rows.select(
        F.coalesce("repo", F.lit("-")).alias("repo"), F.coalesce("branch", F.lit("-")).alias("branch"), folder.alias("folder"),
        F.coalesce("error", F.lit("-")).alias("error"), (F.col("size") - F.length("content")).alias("unread"), F.explode(lines).alias("line"),
    )
    return rows.groupBy("repo", "branch", "folder", "error", "line").agg(F.count("*").alias("n"), F.max("unread").alias("unread"))


@query
def src_listing_checkout(spark, sf):
    """Write a file of every class per document, list the folders in tasks and read the files back: names, sizes and bytes."""
    files = repo_bytes(spark, sf).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit("/"), "path"))
    home = f"{ensure_checkpoint_dir(spark)}/checkouts-{uuid.uuid4().hex}"
    listing.write_checkouts(files, home)
    got = listing.with_content(listing.list_checkouts(spark, home), home)
    return got.select(
        "repo", "branch", "path", "size", F.coalesce("error", F.lit("-")).alias("error"), F.sha2("content", 256).alias("sha")
    )


@query
def src_tree_flat_json(spark, sf):
    docs = views.table(spark, sf, "documents")
    name = F.expr("concat(lang, '/', cast(doc_id AS string))")
    body = F.expr(
        """CASE doc_id % 5
        WHEN 0 THEN concat('[{"path":"', lang, '/', cast(doc_id AS string), '","type":"blob"},{"path":"', lang, '","type":"tree"}]')
        WHEN 1 THEN concat('[{"PATH":"', lang, '/', cast(doc_id AS string), '","Type":"blob","id":7}]')
        WHEN 2 THEN concat('[{"path":"', lang, '/', cast(doc_id AS string), '"}]')
        WHEN 3 THEN '[]' ELSE '{"message":"404"' END"""
    )
    pages = docs.select(F.col("source").alias("repo"), F.lit("main").alias("branch"), F.col("doc_id").alias("page"), body.alias("body"))
    out = responses.tree_flat(pages)
    return out.select("repo", "pos", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("type", F.lit("-")).alias("type"), F.col("error").isNotNull().alias("failed"))


@query
def src_tree_nested_json(spark, sf):
    docs = views.table(spark, sf, "documents")
    entry = """'{"path":"', lang, '/', cast(doc_id AS string), '","type":"blob"}'"""
    body = F.expr(
        f"""CASE doc_id % 5
        WHEN 0 THEN concat('{{"tree":[', {entry}, ',{{"path":"', lang, '","type":"tree"}}],"truncated":false}}')
        WHEN 1 THEN concat('{{"tree":[', {entry}, '],"truncated":true}}')
        WHEN 2 THEN '{{"sha":"x"}}'
        WHEN 3 THEN concat('{{"tree":[{{"path":"x"}},{{"path":" ","type":"blob"}},', {entry}, ']}}')
        ELSE '{{"tree":[]}}' END"""
    )
    pages = docs.select(F.col("source").alias("repo"), F.lit("main").alias("branch"), F.col("doc_id").alias("page"), body.alias("body"))
    out = responses.tree_nested(pages)
    return out.select("repo", "pos", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("error", F.lit("-")).alias("error"))


def content_bodies(spark, sf):
    docs = views.table(spark, sf, "documents")
    packed = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\r?\n", r"\\n")
    body = (
        F.when(F.col("doc_id") % 6 == 4, F.lit('{"type":"dir","content":""}'))
        .when(F.col("doc_id") % 6 == 5, F.lit('{"type":"FILE","size":3}'))
        .otherwise(F.concat(F.lit('{"type":"file","size":'), F.col("doc_id").cast("string"), F.lit(',"content":"'), packed, F.lit('"}')))
    )
    return docs.select("doc_id", body.alias("body"))


@query
def src_content_json(spark, sf):
    out = responses.file_content(content_bodies(spark, sf))
    return out.select("doc_id", F.coalesce(cs.utf8_lenient(F.col("content")), F.lit("-")).alias("text"), F.coalesce("error", F.lit("-")).alias("error"))


@query
def src_text_utf8(spark, sf):
    docs = views.table(spark, sf, "documents")
    content = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 2 == 1, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    named = ["utf-8", "ISO-8859-15", "windows-1252", "us-ascii", "utf-16le", "utf-16be", "x-unknown"]
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    le = F.encode("text", "UTF-16LE")
    kinds = [
        broken, F.encode(F.translate(F.concat(plain, F.lit("\u20ac\u0153")), "\u20ac\u0153", "\xa4\xbd"), "ISO-8859-1"), F.encode(F.concat(plain, F.lit("\x80\x9c")), "ISO-8859-1"),
        F.encode(F.concat(plain, F.lit("\xe9")), "ISO-8859-1"), le, F.encode("text", "UTF-16BE"), broken,
    ]
    pick = F.pmod(F.col("doc_id"), F.lit(len(kinds)))
    content, charset = kinds[0], F.lit(named[0])
    for k in range(1, len(kinds)):
        content, charset = F.when(pick == k, kinds[k]).otherwise(content), F.when(pick == k, F.lit(named[k])).otherwise(charset)
    both = docs.select("doc_id", F.lit("-").alias("charset"), responses.file_text(broken).alias("text"))
    return both.unionByName(docs.select("doc_id", charset.alias("charset"), responses.file_text(content, charset).alias("text")))


@query
def src_size_json(spark, sf):
    docs = views.table(spark, sf, "documents")
    n = F.col("n_chars").cast("string")
    body = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"size":'), n, F.lit("}")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"size":"'), n, F.lit('"}')))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"size":'), n, F.lit(".5}")))
        .when(F.col("doc_id") % 5 == 3, F.lit('{"name":"x"}'))
        .otherwise(F.lit('{"size":1}'))
    )
    header = F.when(F.col("doc_id") % 10 == 4, n).when(F.col("doc_id") % 10 == 9, F.lit("x"))
    out = responses.file_size(docs.select("doc_id", body.alias("body"), header.alias("size_header")))
    return out.select("doc_id", F.coalesce("size", F.lit(-1)).alias("size"))


@query
def src_project_json(spark, sf):
    part = views.table(spark, sf, "part")
    body = F.expr(
        """CASE p_partkey % 4 WHEN 0 THEN concat('{"name":"', p_name, '","html_url":"https://h/', p_partkey, '"}')
        WHEN 1 THEN concat('{"name":"', p_name, '","web_url":"https://w/', p_partkey, '"}')
        WHEN 2 THEN concat('{"name":"', p_name, '"}') ELSE '{"name":null,"web_url":"u"}' END"""
    )
    out = responses.projects(part.select(F.col("p_partkey").cast("string").alias("repo"), body.alias("body")))
    return out.select("repo", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("name", "web_url", "error")])


@query
def src_branches_json(spark, sf):
    part = views.table(spark, sf, "part")
    body = F.expr(
        """CASE p_partkey % 3 WHEN 0 THEN concat('[{"name":"main"},{"name":" "},{},{"name":"b', p_partkey, '"}]')
        WHEN 1 THEN '[]' ELSE '{"message":"x"}' END"""
    )
    pages = part.select(F.col("p_type").alias("repo"), F.col("p_partkey").alias("page"), body.alias("body"))
    return responses.branches(pages).select("repo", "pos", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("error", F.lit("-")).alias("error"))


@query
def union_pages(spark, sf):
    """Items of all listing pages of a repository in input order."""
    items = src_tree_flat_json(spark, sf).filter("NOT failed AND path <> '-'")
    return ordering.positions(items.select("repo", "pos", "path"), ["repo"], ["pos"], "item_no").select("repo", "path", "item_no")


# ---------------------------------------------------------------- classification


def flag_query(name):
    def run(spark, sf):
        return classed(spark, sf).select("doc_id", "path", F.col(name).alias("flag"))

    return run


for _id, _name in {
    "cls_image": "is_image",
    "cls_pdf": "is_pdf",
    "cls_known_text": "is_known_text",
    "cls_known_binary": "is_known_binary",
    "cls_selectable": "by_name_selectable",
    "cls_unknown": "is_unknown",
}.items():
    QUERIES[_id] = flag_query(_name)


@query
def cls_language(spark, sf):
    return classed(spark, sf).select("doc_id", "path", "language")


@query
def text_extensions(spark, sf):
    """Files per extension that counts as text."""
    dim = lk.extension_dim(spark).filter("ext_text")
    files = views.repo_files(spark, sf).select(fp.extension(F.col("path")).alias("ext"))
    return files.join(F.broadcast(dim), "ext").groupBy("ext", F.col("ext_language").alias("language")).agg(F.count("*").alias("n"))


@query
def sniff_binary(spark, sf):
    return views.sniff_bytes(spark, sf).select("doc_id", cs.looks_binary(F.unhex("hx")).alias("is_binary"))


@query
def control_char_count(spark, sf):
    sample = cs.latin1(F.substring(F.unhex("hx"), 1, lk.SNIFF_BYTES))
    count = F.length(sample) - F.length(F.translate(sample, cs.CONTROL_BYTES, ""))
    return views.sniff_bytes(spark, sf).select("doc_id", count.cast("bigint").alias("controls"))


@query
def sample_prefix(spark, sf):
    return repo_bytes(spark, sf).select("doc_id", F.hex(F.substring("content", 1, 4096)).alias("head"))


@query
def inventory(spark, sf):
    return repo_inventory(spark, sf).select(
        "repo", "path", "pos", "class", "language", "selectable", F.coalesce("size", F.lit(-1)).alias("size"),
        F.coalesce("error", F.lit("-")).alias("error"), "large",
    )


@query
def inventory_packed(spark, sf):
    """The inventory of a stored table with sizes and heads, which leaves the bytes unread."""
    files = repo_bytes(spark, sf).withColumn("content", F.when(F.col("doc_id") % 7 != 0, F.col("content")))
    inv = classify.inventory(pinned(classify.packed(files)), large_bytes=1000)
    return inv.select(
        "repo", "path", "pos", "class", "language", "selectable", F.coalesce("size", F.lit(-1)).alias("size"),
        F.coalesce("error", F.lit("-")).alias("error"), "large",
    )


@query
def node_state(spark, sf):
    return classify.node_state(repo_inventory(spark, sf)).select("repo", "pos", "label", "state", "hint")


@query
def large_flag(spark, sf):
    return repo_inventory(spark, sf).select("pos", "large")


@query
def has_selectable(spark, sf):
    return classify.has_selectable(repo_inventory(spark, sf)).select("repo", "has_selectable")


@query
def select_files(spark, sf):
    """A whole repository, a directory and files named one by one."""
    files = views.repo_files(spark, sf)
    whole = files.filter("doc_id % 20 = 0").select("repo", "branch", F.lit("").alias("prefix"), F.lit(False).alias("explicit"))
    folder = files.filter("doc_id % 20 = 1").select("repo", "branch", F.lit("en/d1").alias("prefix"), F.lit(False).alias("explicit"))
    named = files.filter("doc_id % 20 >= 2").select("repo", "branch", F.col("path").alias("prefix"), (F.col("doc_id") % 3 == 0).alias("explicit"))
    chosen = selection.select_files(repo_inventory(spark, sf), whole.union(folder).union(named))
    return chosen.select("repo", "pos", "path")


@query
def reject_binary(spark, sf):
    files = repo_bytes(spark, sf).withColumn(
        "content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("00")), "content")).otherwise(F.col("content"))
    )
    return classify.with_kind(classify.with_classes(files)).select("doc_id", "path", F.coalesce("reason", F.lit("-")).alias("reason"))


@query
def kind_route(spark, sf):
    return classify.with_kind(classify.with_classes(repo_bytes(spark, sf))).select("doc_id", "path", F.coalesce("kind", F.lit("-")).alias("kind"))


@query
def drop_blank(spark, sf):
    turns = views.table(spark, sf, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.lit(" \t\n  ")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", text.alias("text")).filter(~ft.is_blank(F.col("text"))).select("conv_id", "turn")


# ---------------------------------------------------------------- decoding


@query
def decode_text(spark, sf):
    """Documents in six encodings come back as they were."""
    docs = views.table(spark, sf, "documents")
    text, kind = F.col("text"), F.col("doc_id") % 6
    latin = ~text.rlike(r"[^\x00-\xff]")
    bom = lambda h, enc: F.concat(F.unhex(F.lit(h)), F.encode(text, enc))
    content = (
        F.when(kind == 1, bom("EFBBBF", "UTF-8"))
        .when(kind == 2, bom("FFFE", "UTF-16LE"))
        .when(kind == 3, bom("FEFF", "UTF-16BE"))
        .when(kind == 4, F.concat(F.unhex(F.lit("FFFE0000")), utf32le_bytes(text)))
        .when((kind == 5) & latin, F.encode(text, "ISO-8859-1"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return docs.select("doc_id", cs.decode_text(content, F.lit("a.txt")).alias("text"))


def utf32le_bytes(text):
    """UTF-32LE bytes of a text: the big-endian ones with every unit turned round."""
    units = F.hex(F.encode(text, "UTF-32"))
    return F.unhex(F.regexp_replace(units, "(..)(..)(..)(..)", "$4$3$2$1"))


@query
def decode_bom(spark, sf):
    docs = views.table(spark, sf, "documents")
    marked = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    content = F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", F.coalesce(cs.strip_bom(cs.decode_bom(content)), F.lit("-")).alias("text"))


@query
def decode_utf8_strict(spark, sf):
    docs = views.table(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3"))))
    return docs.select("doc_id", F.coalesce(cs.utf8_strict(content), F.lit("-")).alias("text"))


@query
def declared_charset(spark, sf):
    pages = views.table(spark, sf, "pages")
    path = F.when(F.col("page_id") % 3 == 0, F.lit("p.txt")).otherwise(F.lit("p.HTML"))
    return pages.select("page_id", F.coalesce(cs.declared_charset(F.encode("html", "UTF-8"), path), F.lit("-")).alias("charset"))


@query
def charset_alias(spark, sf):
    """Pages that declare different charsets and are encoded in them."""
    pages = views.table(spark, sf, "pages")
    text = F.regexp_replace("html", r"[^\x00-\x7f]", "é")
    named = lambda name: F.replace(text, F.lit("utf-8"), F.lit(name))
    kind = F.col("page_id") % 4
    content = (
        F.when(kind == 0, F.encode(named("latin1"), "ISO-8859-1"))
        .when(kind == 1, F.encode(named("CP1252"), "ISO-8859-1"))
        .when(kind == 2, F.encode(named("no-such"), "UTF-8"))
        .otherwise(F.encode(named("UTF8"), "UTF-8"))
    )
    return pages.select("page_id", cs.decode_text(content, F.lit("x/p.htm")).alias("text"), cs.charset_unsupported(content, F.lit("x/p.htm")).alias("unsupported"))


# ---------------------------------------------------------------- text and path functions


@query
def md_anchor(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", ft.md_anchor(F.col("text")).alias("anchor"))


@query
def md_escape(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", ft.md_escape(F.col("html")).alias("escaped"))


@query
def md_code_block(spark, sf):
    block = ft.md_code_block(F.col("lang"), F.concat("text", F.lit(" \n\t\n")))
    return views.table(spark, sf, "documents").select("doc_id", block.alias("block"))


@query
def asset_link(spark, sf):
    return views.repo_files(spark, sf).select("doc_id", fp.asset_link(F.concat("path", F.lit(" (é).png"))).alias("link"))


@query
def pct(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", fp.percent_encode(F.col("text")).alias("escaped"))


@query
def branch_url(spark, sf):
    pages = views.table(spark, sf, "pages")
    branch = F.concat(F.lit("feat/a b~*"), F.col("page_id").cast("string"))
    return pages.select("page_id", *[fp.branch_url(F.concat("url", F.lit("//")), branch, s).alias(s) for s in ("nested", "flat")])


@query
def content_urls(spark, sf):
    """Addresses to fetch for every file, in both listing styles."""
    files = views.repo_files(spark, sf)
    owner = F.concat(F.lit("me/"), "repo")
    urls = {f"{s}_{k}": v for s in ("nested", "flat") for k, v in fp.content_urls(API, s, owner, F.col("branch"), F.col("path")).items()}
    return files.select("doc_id", *[v.alias(k) for k, v in urls.items()])


@query
def parse_repo_id(spark, sf):
    pages = views.table(spark, sf, "pages")
    ident = F.concat(F.lit(" "), F.regexp_replace("url", "^https?:/", ""), F.lit(" "))
    parsed = pages.select("page_id", fp.parse_repo_id(F.when(F.col("page_id") % 2 == 0, F.lit("/own//name ")).otherwise(ident)).alias("p"))
    return parsed.select("page_id", *[F.coalesce(f"p.{c}", F.lit("-")).alias(c) for c in ("owner", "name", "error")])


@query
def safe_name(spark, sf):
    value = F.when(F.col("page_id") % 3 == 0, F.lit(" .\t")).when(F.col("page_id") % 3 == 1, F.lit(" .. ")).otherwise(F.concat(F.lit(". "), "url", F.lit(" .")))
    return views.table(spark, sf, "pages").select("page_id", ft.safe_name(value).alias("safe"))


@query
def package_name(spark, sf):
    orders = views.table(spark, sf, "orders")
    return orders.select("o_orderkey", ft.package_name(F.col("o_orderdate"), F.col("o_orderpriority"), F.concat(F.lit("a/"), "o_orderstatus")).alias("name"))


@query
def normalize_path(spark, sf):
    return views.repo_files(spark, sf).select("doc_id", fp.normalize_path(F.col("path")).alias("norm"))


@query
def path_parts(spark, sf):
    parts = fp.path_parts(F.concat(F.lit("/"), F.replace(F.col("url"), F.lit("http"), F.lit("//"))))
    return views.table(spark, sf, "pages").select("page_id", F.posexplode(parts).alias("nth", "part")).select("page_id", long("nth"), "part")


@query
def is_root_readme(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, F.lower("path")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ReadMe"), F.lit(""))).otherwise(F.concat(F.lit("a/"), "path"))
    return views.repo_files(spark, sf).select("doc_id", fp.is_root_readme(path).alias("is_readme"))


@query
def format_size(spark, sf):
    size = F.when(F.col("l_linenumber") != 3, (F.col("l_extendedprice") * 100).cast("bigint"))
    df = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size"))
    return df.select("l_orderkey", long("l_linenumber"), ft.format_size(F.col("size")).alias("label"))


@query
def lines(spark, sf):
    """Lines of every document and code file."""
    docs = views.table(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("branch"), F.col("doc_id").cast("string").alias("path"), "text")
    code = views.code_files(spark, sf).select("repo", "branch", "path", F.col("content").alias("text"))
    return tokens.lines(docs.unionByName(code)).select(
        "path", long("line_no"), long("line_start"), long("line_end"), F.coalesce("next_start", F.lit(-1)).cast("bigint").alias("next_start"), long("indent"), "blank"
    )


# ---------------------------------------------------------------- ordering and trees


@query
def distinct_paths(spark, sf):
    return ordering.distinct_paths(views.repo_files(spark, sf)).select("repo", "path", "pos")


@query
def order_export_files(spark, sf):
    return ordering.order_export_files(views.repo_files(spark, sf)).select("repo", "path", F.hex("sort_key").alias("sort_key"))


@query
def file_order(spark, sf):
    return ordering.file_order(views.repo_files(spark, sf)).select("repo", "path", "file_pos")


@query
def sort_tree_items(spark, sf):
    return ordering.sort_tree_items(views.url_tree(spark, sf)).select("repo", "pos", "item_pos")


@query
def tree_nodes(spark, sf):
    return tree.tree_nodes(views.url_tree(spark, sf)).select("repo", "node_key", "parent_key", "name", "is_dir", long("depth"))


@query
def is_last_child(spark, sf):
    return tree.with_last_child(tree.tree_nodes(views.url_tree(spark, sf))).select("repo", "node_key", "is_last")


@query
def sort_tree(spark, sf):
    nodes = tree.tree_nodes(views.url_tree(spark, sf)).withColumn("sibling_key", tree.sibling_key())
    ranked = ordering.positions(nodes, ["repo", "branch", "parent_key"], ["sibling_key"], "sibling_no")
    return ranked.select("repo", "node_key", "sibling_no")


def url_projects(spark, sf):
    hosts = views.url_tree(spark, sf).select("repo").distinct()
    return hosts.select("repo", F.concat(F.lit("P "), "repo").alias("name"), F.concat(F.lit("https://"), "repo", F.lit("/")).alias("web_url"))


@query
def tree_listing(spark, sf):
    listing = tree.tree_listing(views.url_tree(spark, sf), url_projects(spark, sf))
    ranked = ordering.positions(listing, ["repo", "branch"], ["line_key"], "line_no")
    return ranked.select("repo", "line_no", "line")


@query
def nodes_to_ancestors(spark, sf):
    """Indented lines of all nodes below the top level."""
    lines_ = tree.tree_lines(tree.tree_nodes(views.url_tree(spark, sf)))
    return lines_.filter(F.col("line").rlike(r"^[|\\ ][  ]{2}")).select("repo", "line")


@query
def tree_text(spark, sf):
    listing = tree.tree_listing(views.url_tree(spark, sf), url_projects(spark, sf))
    return tree.tree_text(listing).select("repo", "tree_text")


@query
def unique_package_name(spark, sf):
    """A free name per customer order: names by segment and day, some taken already."""
    orders = views.table(spark, sf, "orders")
    base = F.concat("o_orderpriority", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM"))
    wanted = orders.select(base.alias("name"), F.col("o_orderkey").alias("pos"))
    taken = orders.filter("o_orderkey % 5 = 0").select(
        F.when(F.col("o_orderkey") % 10 == 0, base).otherwise(F.concat(base, F.lit(" ("), (F.col("o_orderkey") % 7 + 2).cast("string"), F.lit(")"))).alias("name")
    )
    return ordering.unique_package_names(wanted, taken.distinct()).select(F.col("pos").alias("o_orderkey"), "free_name")


# ---------------------------------------------------------------- functions


@query
def fn_dispatch(spark, sf):
    df = fn.prepared(code_units(spark, sf).unionByName(doc.file_units(repo_bytes(spark, sf))))
    return df.groupBy("language", F.coalesce("dialect", F.lit("-")).alias("dialect")).agg(F.count("*").alias("n"))


@query
def fn_names(spark, sf):
    return fn.function_names(code_units(spark, sf)).select("path", long("emit_pos"), "name")


def spans_as(df):
    return df.select("path", "name", long("start", "start_pos"), long("end", "end_pos"))


@query
def fn_spans(spark, sf):
    df = fn.function_spans(code_units(spark, sf))
    return df.select("path", long("emit_pos"), "name", long("start", "start_pos"), long("end", "end_pos"))


def language_spans(*languages):
    def run(spark, sf):
        return spans_as(fn.function_spans(code_units(spark, sf).filter(F.col("language").isin(*languages))))

    return run


QUERIES["until_next"] = language_spans("java")
QUERIES["lua_block_end"] = language_spans("lua")
QUERIES["indent_block_end"] = language_spans("python")
QUERIES["union_methods_types"] = language_spans("csharp")


@query
def leading_trivia(spark, sf):
    """How far above its signature each function starts."""
    df = fn.all_spans(code_units(spark, sf)).filter("dialect <> 'java'")
    spans = df.select("path", F.inline("raw_spans"))
    return spans.select("path", "name", long("start", "start_pos"))


@query
def type_leaf_anti_method(spark, sf):
    df = fn.all_spans(code_units(spark, sf)).filter(F.col("dialect") == "csharp")
    spans = F.col("raw_spans")
    kept = fn.without_inner(F.filter(spans, fn.is_type), F.filter(spans, lambda s: ~fn.is_type(s)))
    return spans_as(df.select("path", F.inline(kept)))


@query
def type_leaf_anti_type(spark, sf):
    df = fn.all_spans(code_units(spark, sf)).filter(F.col("dialect") == "csharp")
    types = F.filter(F.col("raw_spans"), fn.is_type)
    return spans_as(df.select("path", F.inline(fn.without_inner(types, types))))


@query
def union_candidates(spark, sf):
    """JavaScript and Lua signatures of all forms together."""
    df = fn.prepared(code_units(spark, sf)).filter(F.col("dialect").isin("js", "lua"))
    text = F.col("lex_text")
    found = F.when(F.col("dialect") == "js", sg.js_candidates(text)).otherwise(sg.lua_candidates(text))
    return df.select("path", F.inline(found)).select("path", "rule", "name", long("idx"))


@query
def distinct_candidates(spark, sf):
    """Signatures once per name and start, from candidates that repeat."""
    df = fn.prepared(code_units(spark, sf)).filter(F.col("dialect") == "js")
    twice = F.expr("flatten(transform(found, c -> array(c, c)))")
    df = fenced(df, found=sg.js_candidates(F.col("lex_text")))
    df = fenced(df, found=twice)
    return df.select("path", F.inline(sg.js_signatures(F.col("found")))).select("path", "name", long("idx"))


def body_query(dialect, *rules):
    def run(spark, sf):
        df = fn.signatures(code_units(spark, sf)).filter(F.col("dialect") == dialect)
        df = fenced(df, ends=block_ends(F.col("lex_text"), F.col("sigs"), dialect))
        df = df.select("path", F.inline(F.arrays_zip("sigs", "ends"))).filter(F.col("sigs.rule").isin(*rules))
        return df.select("path", "sigs.name", long("sigs.idx", "idx"), long("ends", "end_pos"))

    return run


QUERIES["js_statement_end"] = body_query("js", "js_arrow")
QUERIES["py_block_end"] = body_query("python", "python")


def body_starts(spark, sf, dialect, *rules):
    """Where the body of each signature opens, -1 when it has none."""
    df = code_sigs(spark, sf, *rules)
    df = fenced(df, body_pos=body_start(F.col("text"), F.struct("name", "idx", "brace", "piece"), dialect))
    return df.select("path", "name", long("idx"), long("body_pos"), F.substring("text", F.col("body_pos") + 1, F.lit(1)).alias("opener"))


JS_RULES = ("js_function", "js_arrow", "js_method")


@query
def js_body(spark, sf):
    return body_starts(spark, sf, "js", *JS_RULES).drop("opener")


@query
def rust_body(spark, sf):
    return body_starts(spark, sf, "rust", "rust").drop("opener")


@query
def open_brace_of_signature(spark, sf):
    """Signatures of three dialects whose body opens with a brace."""
    found = [body_starts(spark, sf, d, *r) for d, r in {"js": JS_RULES, "php": ["php"], "rust": ["rust"]}.items()]
    return found[0].union(found[1]).union(found[2]).filter("body_pos >= 0 and opener = '{'").drop("opener")


@query
def py_signature_end(spark, sf):
    """Where the text after each Python signature begins."""
    from repoloom.operators.blocks import PYTHON_HEADER

    df = code_sigs(spark, sf, "python")
    size = F.length(F.regexp_extract("piece", PYTHON_HEADER, 0))
    return df.select("path", "name", long("idx"), (F.col("idx") + size).cast("bigint").alias("body_pos"))


def token_query(*dialects):
    def run(spark, sf):
        found = tokens.code_tokens(code_units(spark, sf)).filter(F.col("dialect").isin(*dialects))
        return found.select("path", long("off"), "token")

    return run


QUERIES["lex_csharp"] = token_query("csharp")
QUERIES["lex_js"] = token_query("js")
QUERIES["lex_php"] = token_query("php")
QUERIES["lex_rust"] = token_query("rust")
QUERIES["lex_lua"] = token_query("lua")


@query
def brace_depth(spark, sf):
    df = tokens.brace_depth(tokens.code_tokens(code_units(spark, sf)))
    return df.select("path", long("off"), "token", long("depth"))


@query
def match_brace(spark, sf):
    df = tokens.block_pairs(tokens.brace_depth(tokens.code_tokens(code_units(spark, sf))))
    return df.select("path", long("open_off"), long("close_off"))


# ---------------------------------------------------------------- outline and documents


@query
def valid_spans(spark, sf):
    """Spans of the code files, shifted so that some leave their text."""
    df = fn.with_spans(code_units(spark, sf))
    moved = F.transform("spans", lambda s, i: F.struct(s["name"].alias("name"), (s["start"] - i * 20).alias("start"), (s["end"] + i * 20).alias("end")))
    return spans_as(df.select("path", F.inline(fn.valid_spans(moved, F.length("text")))))


@query
def sort_spans(spark, sf):
    df = fn.with_spans(code_units(spark, sf))
    ordered = df.select("path", F.posexplode(outline.sorted_spans(F.col("spans"))).alias("nth", "s"))
    return ordered.select("path", long("nth"), F.col("s.name").alias("name"))


def with_duplicates(spark, sf):
    """Code files written twice into one text, so that names repeat."""
    units = code_units(spark, sf)
    again = F.concat("text", F.lit("\n"), F.upper("text"), F.lit("\n"), "text")
    return units.withColumn("text", F.when(F.col("language").isin("php", "lua"), again).otherwise(F.col("text")))


@query
def occurrence_label(spark, sf):
    df = outline.outline(fn.with_spans(with_duplicates(spark, sf)))
    return df.select("path", long("ord"), "qualified_name", "display_name")


@query
def outline_(spark, sf):
    df = outline.outline(fn.with_spans(code_units(spark, sf)))
    return df.select("path", long("ord"), long("parent_ord"), long("depth"), "qualified_name", "display_name", "anchor", long("start", "start_pos"), long("end", "end_pos"))


QUERIES["outline"] = QUERIES.pop("outline_")


@query
def outline_preorder(spark, sf):
    df = outline.outline(fn.with_spans(code_units(spark, sf)))
    return df.select("path", long("ord"), "display_name")


@query
def span_parent(spark, sf):
    """Nesting of a table of spans made from order lines: quantity and line number as interval."""
    items = views.table(spark, sf, "lineitem")
    start, size = F.col("l_linenumber") * 3, F.col("l_quantity").cast("int")
    spans = items.select(
        F.lit("r").alias("repo"), F.lit("b").alias("branch"), F.col("l_orderkey").cast("string").alias("path"),
        F.col("l_linenumber").alias("emit_pos"), F.col("l_linenumber").cast("string").alias("name"), start.alias("start"), (start + size).alias("end"),
    )
    return outline.span_parents(spans).select("path", "name", long("ord"), long("parent_ord"), "qualified_name")


@query
def files_to_spans(spark, sf):
    """Functions per file, files without any included."""
    df = fn.with_spans(code_units(spark, sf).unionByName(doc.file_units(repo_bytes(spark, sf)).filter("kind = 'text'")))
    return df.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.size("spans")).alias("functions"))


@query
def segment_gaps(spark, sf):
    df = outline.with_segments(outline.with_outline(fn.with_spans(code_units(spark, sf))))
    df = df.select("path", F.inline(F.filter("segments", lambda s: s["kind"].isin("gap", "tail"))))
    return df.select("path", "kind", long("start", "start_pos"), long("end", "end_pos"))


@query
def code_segments(spark, sf):
    df = outline.code_segments(fn.with_spans(code_units(spark, sf)))
    return df.select("path", "kind", long("ord"), F.coalesce("code", F.lit("-")).alias("code"))


def code_projects(spark, sf):
    repos = views.code_files(spark, sf).select("repo").distinct()
    return repos.select("repo", F.concat("repo", F.lit(" #1")).alias("name"), F.concat(F.lit("https://git.example.org/"), "repo", F.lit("/")).alias("web_url"))


def code_corpus(spark, sf):
    files = views.code_files(spark, sf)
    items = files.select("repo", "branch", F.col("k").alias("pos"), "path", F.lit("blob").alias("type"))
    stored = files.select("repo", "branch", "path", F.encode("content", "UTF-8").alias("content"))
    return doc.merge_corpus(stored, items, code_projects(spark, sf), STAMP)


def mixed_corpus(spark, sf):
    """One repository per document source; some paths repeat."""
    files = repo_bytes(spark, sf)
    items = files.select("repo", "branch", "pos", "path", F.lit("blob").alias("type"))
    projects = files.select("repo").distinct().select("repo", F.concat(F.lit("My_"), "repo").alias("name"), F.concat(F.lit("https://git.example.org/"), "repo").alias("web_url"))
    # Files named .env.zip are known text and known binary: they are rejected, not exported.
    return doc.merge_corpus(files.select("repo", "branch", "pos", "path", "content"), items, projects, STAMP)


@query
def toc(spark, sf):
    return code_corpus(spark, sf)["files"].select("path", "toc")


@query
def file_section(spark, sf):
    return code_corpus(spark, sf)["files"].select("path", "section")


@query
def doc_header(spark, sf):
    return code_corpus(spark, sf)["headers"].select("repo", "file_name", "header")


@query
def merged_document(spark, sf):
    """Documents of the mixed repositories as one text each."""
    return doc.merged_document(mixed_corpus(spark, sf)["blocks"]).select("repo", long("piece"), "text")


@query
def merge_corpus(spark, sf):
    """The flagship job: every code repository as numbered document lines."""
    return doc.document_lines(code_corpus(spark, sf)["blocks"]).select("repo", "line_no", "text")


@query
def sink_markdown(spark, sf):
    """Documents written under names of their own and read back by the manifest, line by line."""
    home = f"{ensure_checkpoint_dir(spark)}/markdown-{uuid.uuid4().hex}"
    made = mixed_corpus(spark, sf)
    writers.write_markdown(made["blocks"], made["headers"], home)
    return writers.read_markdown(spark, home)


@query
def sink_assets(spark, sf):
    """Manifest of copied images and PDF files."""
    home = f"{ensure_checkpoint_dir(spark)}/assets-{uuid.uuid4().hex}"
    writers.write_assets(mixed_corpus(spark, sf)["assets"], home)
    back = spark.read.parquet(home)
    return back.select("repo", "path", "asset_path", F.length("content").cast("bigint").alias("bytes"))

"""Tables from stored responses of Git hosts.

Each function takes a table with a `body` column (JSON text) next to its keys and
never infers a schema. Bad responses become rows with `error`; with `strict` the
first one fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.charset import charset_alias, decode_as, strip_bom, utf8_lenient
from repoloom.functions.text import is_blank

# Input order of listing items: page number above, position in the page below.
PAGE_STEP = 1 << 32


def _checked(df: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return df
    return df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))


def _listed(df: DataFrame, keys: list[str], entries: Column, error: Column) -> DataFrame:
    """One row per entry, or one row with the error of a page that has none."""
    return df.withColumn("error", error).select(
        *keys, "page", "error", F.posexplode_outer(F.when(F.col("error").isNull(), entries)).alias("nth", "entry")
    )


def _pos() -> Column:
    return (F.col("page").cast("bigint") * PAGE_STEP + F.coalesce("nth", F.lit(0))).alias("pos")


def _any_case(entry: str, name: str) -> Column:
    """Last property of a JSON object whose name equals `name` ignoring case."""
    named = F.filter(F.map_entries(entry), lambda kv: F.lower(kv["key"]) == name)
    return F.get(named, F.size(named) - 1)["value"]


def tree_flat(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Tree items from listing pages, arrays of {path, type}; property names in any case."""
    body = F.from_json("body", "array<map<string,string>>")
    df = pages.withColumn("items", body)
    error = F.when(F.col("items").isNull(), "response is not a JSON array")
    rows = _listed(df, ["repo", "branch"], F.col("items"), error).filter(
        F.col("entry").isNotNull() | F.col("error").isNotNull()
    )
    ok = F.col("error").isNull()
    return _checked(
        rows.select(
            "repo",
            "branch",
            _pos(),
            F.when(ok, F.coalesce(_any_case("entry", "path"), F.lit(""))).alias("path"),
            F.when(ok, F.coalesce(_any_case("entry", "type"), F.lit(""))).alias("type"),
            "error",
        ),
        strict,
    )


def tree_nested(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Tree items from {tree: [{path, type}], truncated}; entries without path or type are dropped."""
    df = pages.withColumn("doc", F.from_json("body", "truncated boolean, tree array<struct<path:string,type:string>>"))
    error = F.when(F.col("doc.truncated"), "tree is truncated").when(
        F.col("doc.tree").isNull(), "response has no tree array"
    )
    rows = _listed(df, ["repo", "branch"], F.col("doc.tree"), error).filter(
        F.col("error").isNotNull() | ~(is_blank(F.col("entry.path")) | is_blank(F.col("entry.type")))
    )
    return _checked(rows.select("repo", "branch", _pos(), "entry.path", "entry.type", "error"), strict)


def file_content(responses: DataFrame, strict: bool = False) -> DataFrame:
    """File bytes from {type: file, content: base64}."""
    df = responses.withColumn("doc", F.from_json("body", "type string, content string"))
    packed = F.regexp_replace("doc.content", r"[\r\n]", "")
    df = df.withColumn("content", F.when(F.lower("doc.type") == "file", F.try_to_binary(packed, F.lit("base64"))))
    error = (
        F.when(F.coalesce(F.lower("doc.type"), F.lit("")) != "file", "path is not a file")
        .when(F.col("doc.content").isNull(), "response has no content")
        .when(F.col("content").isNull(), "content is not base64")
    )
    keys = [c for c in responses.columns if c != "body"]
    return _checked(df.withColumn("error", error).select(*keys, "content", "error"), strict)


def file_size(responses: DataFrame) -> DataFrame:
    """Size from an integral JSON number, else null; a `size_header` column wins when it is a number."""
    size = F.from_json("body", "size bigint")["size"]
    if "size_header" in responses.columns:
        size = F.coalesce(F.expr("try_cast(size_header AS bigint)"), size)
    keys = [c for c in responses.columns if c not in ("body", "size_header")]
    return responses.select(*keys, size.alias("size"))


def projects(responses: DataFrame, strict: bool = False) -> DataFrame:
    """Project name and web address; an error when either is missing."""
    df = responses.withColumn("doc", F.from_json("body", "name string, html_url string, web_url string"))
    url = F.coalesce("doc.html_url", "doc.web_url")
    error = F.when(F.col("doc.name").isNull(), "response has no name").when(url.isNull(), "response has no address")
    ok = F.col("error").isNull()
    return _checked(
        df.withColumn("error", error).select(
            "repo", F.when(ok, F.col("doc.name")).alias("name"), F.when(ok, url).alias("web_url"), "error"
        ),
        strict,
    )


def branches(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Branch names from all listing pages; blank and missing names are dropped."""
    df = pages.withColumn("items", F.from_json("body", "array<struct<name:string>>"))
    is_array = F.startswith(F.ltrim(F.col("body"), F.lit(" \t\r\n")), F.lit("["))
    error = F.when(F.col("items").isNull() | ~is_array, "response is not a JSON array")
    rows = _listed(df, ["repo"], F.col("items"), error).filter(
        F.col("error").isNotNull() | ~is_blank(F.col("entry.name"))
    )
    return _checked(rows.select("repo", _pos(), "entry.name", "error"), strict)


def file_text(content: Column, charset: Column | None = None) -> Column:
    """Raw file bytes as text: UTF-8, or the charset the response declared where there is a decoder for it."""
    if charset is None:
        return utf8_lenient(content)
    return strip_bom(F.coalesce(decode_as(charset_alias(F.lower(charset)), content), utf8_lenient(content)))

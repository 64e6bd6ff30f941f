"""Classify files by name and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import lookups as lk
from repoloom.functions.charset import looks_binary
from repoloom.functions.paths import extension, file_name
from repoloom.functions.text import is_blank

# Labels and hints shown for files that cannot be selected.
FAILED_SUFFIX = " (analyse impossible)"
FAILED_HINT = "Analyse du fichier impossible, selection desactivee."
BINARY_HINT = "Fichier binaire non exportable."


def with_classes(files: DataFrame, path: str = "path") -> DataFrame:
    """Add the class flags and the language tag of each file name.

    Two joins with dimension tables of fixed size; no shuffle of the files.
    """
    spark = files.sparkSession
    df = (
        files.withColumn("ext", extension(F.col(path)))
        .withColumn("name_key", F.lower(file_name(F.col(path))))
        .join(F.broadcast(lk.extension_dim(spark)).withColumnRenamed("ext", "dim_ext"), F.col("ext") == F.col("dim_ext"), "left")
        .join(F.broadcast(lk.file_name_dim(spark)), "name_key", "left")
    )

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    dotenv = F.startswith(F.col("name_key"), F.lit(lk.DOTENV_PREFIX))
    text = flag("ext_text") | F.col("name_language").isNotNull() | dotenv
    language = F.coalesce(
        "name_language",
        F.when(dotenv, F.lit(lk.DOTENV_LANGUAGE)),
        "ext_language",
        F.lit(lk.DEFAULT_LANGUAGE),
    )
    selectable = flag("ext_image") | flag("ext_pdf") | text
    return df.select(
        *[F.col(c) for c in files.columns],
        flag("ext_image").alias("is_image"),
        flag("ext_pdf").alias("is_pdf"),
        text.alias("is_known_text"),
        flag("ext_binary").alias("is_known_binary"),
        selectable.alias("by_name_selectable"),
        (~selectable & ~flag("ext_binary")).alias("is_unknown"),
        language.alias("language"),
    )


def file_class() -> Column:
    """First class that applies, in the order in which files are routed."""
    return (
        F.when(F.col("is_image"), "image")
        .when(F.col("is_pdf"), "pdf")
        .when(F.col("is_known_text"), "text")
        .when(F.col("is_known_binary"), "binary")
        .otherwise("unknown")
    )


def reject_reason(binary_content: Column) -> Column:
    """Why a selected file cannot be exported, null when it can.

    A name can be both known text and known binary (`.env.zip`); then it is rejected.
    """
    return F.when(F.col("is_known_binary"), "known binary file").when(
        F.col("is_unknown") & binary_content, "binary content"
    )


def with_kind(classed: DataFrame, strict: bool = False) -> DataFrame:
    """Add `reason` and `kind` (image, pdf, text; null when rejected).

    A file of a known type whose bytes are missing is rejected too. With `strict`, the
    first rejected file fails the job.
    """
    reason = F.coalesce(
        reject_reason(looks_binary(F.col("content"))),
        F.when(F.col("content").isNull(), "file without readable bytes"),
    )
    kind = F.when(F.col("is_image"), "image").when(F.col("is_pdf"), "pdf").otherwise("text")
    df = classed.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), kind))
    if not strict:
        return df
    message = F.concat(F.lit("file '"), F.col("path"), F.lit("' was selected but is a "), F.col("reason"))
    return df.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(message)))


def large_flag(size: Column, selectable: Column, limit: int = lk.LARGE_FILE_BYTES) -> Column:
    return F.coalesce(size >= limit, F.lit(False)) & selectable


def file_size(columns: list[str]) -> Column:
    """Listed size of a file where there is one, else the length of its bytes; unknown types are measured.

    With a `head` the listed size is that of the bytes.
    """
    if "head" in columns:
        return F.when(~F.col("is_unknown") | F.col("head").isNotNull(), F.col("size"))
    measured = F.length("content").cast("bigint")
    listed = F.coalesce(F.col("size"), measured) if "size" in columns else measured
    return F.when(F.col("is_unknown"), measured).otherwise(listed)


def packed(files: DataFrame) -> DataFrame:
    """Files with `size` and `head`, for storing: an inventory of the stored table doesn't read `content`.

    `head` holds the sniffed bytes of files of unknown type; other types are never sniffed. Sizes are those of the bytes,
    listed ones where a file has none.
    """
    measured = F.length("content").cast("bigint")
    size = F.coalesce(measured, F.col("size")) if "size" in files.columns else measured
    df = with_classes(files.drop("head"))
    head = F.when(F.col("is_unknown"), F.substring("content", 1, lk.SNIFF_BYTES))
    keep = [c for c in files.columns if c not in ("size", "head", "content")]
    return df.select(*keep, size.alias("size"), head.alias("head"), "content")


def inventory(files: DataFrame, large_bytes: int = lk.LARGE_FILE_BYTES) -> DataFrame:
    """One row per file: class, language, whether it can be selected, size, error, large.

    Unknown types are sniffed. A file whose bytes are missing is not selectable and
    carries an error instead of failing the run. A `type` column, where present, keeps
    blobs only; blank paths are dropped. Where `head` and `size` are columns (`packed`, `with_head`), `content` isn't read.
    """
    df = files.filter(~is_blank(F.col("path")))
    if "type" in df.columns:
        df = df.filter(F.lower("type") == "blob")
    size = file_size(df.columns)
    sample = F.col("head" if "head" in df.columns else "content")
    df = with_classes(df)
    selectable = F.when(
        F.col("is_unknown"), F.coalesce(~looks_binary(sample), F.lit(False))
    ).otherwise(F.col("by_name_selectable"))
    failed = F.col("is_unknown") & sample.isNull()
    keys = [c for c in ("repo", "branch", "pos", "path") if c in df.columns]
    df = df.select(
        *keys,
        file_class().alias("class"),
        "language",
        selectable.alias("selectable"),
        size.alias("size"),
        F.when(failed, "bytes not readable").alias("error"),
    )
    return df.withColumn("large", large_flag(F.col("size"), F.col("selectable"), large_bytes))


def node_state(inv: DataFrame) -> DataFrame:
    """Label, state and hint of each file for a selection list."""
    name = F.element_at(F.filter(F.split("path", "/"), lambda p: p != ""), -1)
    failed = F.col("error").isNotNull()
    return inv.withColumns(
        {
            "label": F.when(failed, F.concat(name, F.lit(FAILED_SUFFIX))).otherwise(name),
            "state": F.when(F.col("selectable"), "selectable").when(failed, "failed").otherwise("binary"),
            "hint": F.when(F.col("selectable"), "").when(failed, FAILED_HINT).otherwise(BINARY_HINT),
        }
    )


def has_selectable(inv: DataFrame) -> DataFrame:
    return inv.groupBy("repo", "branch").agg(F.bool_or("selectable").alias("has_selectable"))

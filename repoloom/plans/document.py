"""Merge each repository into one Markdown document.

A document is a set of blocks ordered by `(part, key)`: header, tree lines, table of
contents, file sections. Rendering a file happens in its own row; only finished blocks
move, and they are range-partitioned by their order, so that a repository of any size
spreads over many tasks.
"""

from __future__ import annotations

import datetime
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import lookups as lk
from repoloom.functions.charset import charset_unsupported, decode_text, looks_binary
from repoloom.functions.paths import asset_link, asset_path, branch_url, export_sort_key, file_name, normalize_path
from repoloom.functions.rowscan import fenced, int_div
from repoloom.functions.text import is_blank, md_anchor, md_code_block, md_escape, package_name
from repoloom.operators.classify import file_size, inventory, with_classes, with_kind
from repoloom.operators.outline import with_outline, with_segments
from repoloom.operators.ranking import running_totals
from repoloom.operators.selection import select_files
from repoloom.operators.tree import tree_listing
from repoloom.plans.functions import with_spans
from repoloom.session import pinned

# Headings of a document.
BRANCH_LABEL = "Branche du depot : "
TREE_HEADING = "## Arborescence"
TOC_HEADING = "## Table des matieres"

HEADER, TREE, TREE_END, TOC, TOC_END, FILES = range(6)
ORDER = ["part", "key", "path"]
KEYS = ["repo", "branch", "path"]


def file_units(files: DataFrame, strict: bool = False) -> DataFrame:
    """Selected files with kind, language and, for text, the decoded content.

    `files(repo, branch, path, content)` holds each path once. Rejected files keep
    their `reason` and get neither kind nor text.
    """
    df = files.select("repo", "branch", normalize_path(F.col("path")).alias("path"), "content")
    df = with_kind(with_classes(df.filter(~is_blank(F.col("path")))), strict)
    as_text = F.col("kind") == "text"
    return df.withColumns(
        {
            "text": F.when(as_text, decode_text(F.col("content"), F.col("path"))),
            "charset_unsupported": as_text & charset_unsupported(F.col("content"), F.col("path")),
        }
    )


def distinct_files(files: DataFrame) -> DataFrame:
    """Each normalised path of a branch once: its first row by `pos`, where given, then by content.

    Repeated paths are found from the narrow key columns and stored, so that their measured
    size decides whether they are broadcast; content moves for repeated paths only.
    """
    df = files.filter(~is_blank(F.col("path"))).withColumn("path", normalize_path(F.col("path")))
    repeated = pinned(df.groupBy(*KEYS).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if repeated.isEmpty():
        return df
    order = F.struct(*[c for c in ("pos", "content") if c in df.columns])
    rest = [c for c in df.columns if c not in KEYS]
    first = df.join(repeated, KEYS, "left_semi").groupBy(*KEYS).agg(F.min_by(F.struct(*rest), order).alias("row"))
    return df.join(repeated, KEYS, "left_anti").unionByName(first.select(*KEYS, "row.*"))


def file_anchor() -> Column:
    return md_anchor(F.concat(F.lit("file-"), F.col("path")))


@cache
def _toc() -> Column:
    line = F.transform(
        F.col("entries"),
        lambda e: F.concat(F.lit("  - ["), md_escape(e["display_name"]), F.lit("](#"), e["anchor"], F.lit(")\n")),
    )
    head = F.concat(F.lit("- ["), md_escape(F.col("path")), F.lit("](#"), file_anchor(), F.lit(")\n"))
    return F.concat(head, F.array_join(line, ""))


@cache
def _section() -> Column:
    path, text, entries = F.col("path"), F.col("text"), F.col("entries")
    link = F.concat(F.lit("["), md_escape(file_name(path)), F.lit("]("), asset_link(path), F.lit(")\n\n"))

    def render(s: Column) -> Column:
        entry = F.get(entries, s["ord"] - 1)
        head = F.concat(
            F.lit('<a name="'), entry["anchor"], F.lit('"></a>\n#### '), md_escape(entry["display_name"]), F.lit("\n\n")
        )
        code = md_code_block(F.col("language"), F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.when(s["kind"] == "heading", head).otherwise(F.coalesce(code, F.lit("")))

    code = F.array_join(F.transform(F.col("segments"), render), "")
    body = F.when(F.col("kind") == "image", F.concat(F.lit("!"), link)).when(F.col("kind") == "pdf", link).otherwise(code)
    return F.concat(F.lit('<a name="'), file_anchor(), F.lit('"></a>\n### '), md_escape(path), F.lit("\n\n"), body)


def rendered(units: DataFrame) -> DataFrame:
    """One row per exported file: sort key, table-of-contents lines, section text."""
    df = with_segments(with_outline(with_spans(units.filter(F.col("kind").isNotNull()))))
    df = fenced(df, toc=_toc(), section=_section())
    return df.select(*KEYS, export_sort_key(F.col("path")).alias("sort_key"), "toc", "section")


def doc_headers(
    branches: DataFrame, projects: DataFrame, stamp: datetime.datetime, style: str = "flat", strict: bool = False
) -> DataFrame:
    """File name and header text of each document.

    A repository without a project row, or with one that has no name, keeps its document
    under its own id, with `error` set; with `strict` it fails the job.
    """
    df = branches.select("repo", "branch").join(projects.select("repo", "name", "web_url"), "repo", "left")
    error = F.concat(F.lit("no project named for "), F.col("repo"))
    # Raised where the name is needed: an error column that nobody reads is pruned.
    name = F.when(F.col("name").isNull(), F.raise_error(error) if strict else F.col("repo")).otherwise(F.col("name"))
    df = df.withColumn("error", F.when(F.col("name").isNull(), error)).withColumns(
        {"name": name, "web_url": F.coalesce("web_url", F.lit(""))}
    )
    now = F.lit(stamp.replace(tzinfo=None)).cast("timestamp_ntz")
    df = df.withColumn("file_name", package_name(now, F.col("name"), F.col("branch")))
    header = F.concat(
        F.lit("# "), md_escape(F.col("name")),
        F.lit(f"\n\n{BRANCH_LABEL}["), md_escape(F.col("branch")),
        F.lit("]("), branch_url(F.col("web_url"), F.col("branch"), style),
        F.lit(")\n\n## "), md_escape(F.col("file_name")),
        F.lit(f"\n\n{TREE_HEADING}\n\n~~~text\n"),
    )
    return df.select("repo", "branch", "file_name", header.alias("header"), "error")


def document_blocks(files: DataFrame, listing: DataFrame, headers: DataFrame) -> DataFrame:
    """All blocks `(repo, branch, part, key, path, text)`; each text ends with a line feed.

    `files` is the output of `rendered`, `listing` of `tree_listing`, `headers` of
    `doc_headers`.
    """

    def block(part: int, key: Column, path: Column, text: Column) -> list[Column]:
        return [F.lit(part).alias("part"), key.alias("key"), path.alias("path"), text.alias("text")]

    none, ids = F.lit(""), ["repo", "branch"]
    fixed = headers.select(
        *ids,
        F.inline(
            F.array(
                F.struct(*block(HEADER, none, none, F.col("header"))),
                F.struct(*block(TREE_END, none, none, F.lit(f"~~~\n\n{TOC_HEADING}\n\n"))),
                F.struct(*block(TOC_END, none, none, F.lit("\n"))),
            )
        ),
    )
    tree = listing.join(headers.select(*ids), ids, "left_semi").select(
        *ids, *block(TREE, F.col("line_key"), none, F.concat("line", F.lit("\n")))
    )
    parts = files.select(
        *ids,
        F.inline(
            F.array(
                F.struct(*block(TOC, F.col("sort_key"), F.col("path"), F.col("toc"))),
                F.struct(*block(FILES, F.col("sort_key"), F.col("path"), F.col("section"))),
            )
        ),
    )
    return fixed.unionByName(tree).unionByName(parts)


def document_lines(blocks: DataFrame) -> DataFrame:
    """Documents as numbered lines `(repo, branch, line_no, text)`."""
    stored = pinned(blocks)
    count = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    keys = ["repo", "branch", *ORDER]
    starts = running_totals(stored.select(*keys, count.alias("n")), ["repo", "branch"], ORDER, {"before": F.col("n")})
    lines = F.split(F.expr("left(text, length(text) - 1)"), "\n", -1)
    return (
        stored.join(starts.drop("n"), keys)
        .select("repo", "branch", "before", F.posexplode(lines).alias("nth", "text"))
        .select("repo", "branch", (F.col("before") + F.col("nth") + 1).alias("line_no"), "text")
    )


def merged_document(blocks: DataFrame, piece_chars: int = 64_000_000) -> DataFrame:
    """Documents as text `(repo, branch, piece, text)`.

    A document is one piece unless it is longer than `piece_chars`; then it is cut
    between blocks, and joining the pieces in order gives the whole document. So no cell
    and no group outgrows a task, whatever the size of a repository.
    """
    stored = pinned(blocks)
    keys = ["repo", "branch", *ORDER]
    starts = running_totals(
        stored.select(*keys, F.length("text").alias("n")), ["repo", "branch"], ORDER, {"before": F.col("n")}
    )
    pieces = starts.select(*keys, int_div(F.col("before"), piece_chars).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, "text")))
    return (
        stored.join(pieces, keys)
        .groupBy("repo", "branch", "piece")
        .agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "").alias("text"))
    )


def assets(units: DataFrame) -> DataFrame:
    """Bytes of exported images and PDF files with their place in the package."""
    return units.filter(F.col("kind").isin("image", "pdf")).select(
        *KEYS, asset_path(F.col("path")).alias("asset_path"), "content"
    )


def merge_corpus(
    files: DataFrame,
    tree_items: DataFrame,
    projects: DataFrame,
    stamp: datetime.datetime,
    selection: DataFrame | None = None,
    style: str = "flat",
    strict: bool = False,
    large_bytes: int = lk.LARGE_FILE_BYTES,
) -> dict[str, DataFrame]:
    """The whole job: units, rendered files, headers, tree listing, blocks and assets.

    Every path counts once (`distinct_files`). Without a selection the files are filtered
    in place; with one, the chosen paths are stored and joined back to the files. Files of
    `large_bytes` or more are left out unless a selection names them; `inventory` marks
    them as large.
    """
    files = distinct_files(files)
    inv = inventory(files, large_bytes)
    branches = ["repo", "branch"]
    if selection is None:
        chosen = _with_inventory_filter(files, large_bytes)
        # Documents are wanted for every listed branch and every branch with files; with a
        # selection, for what was selected from. Either is known without reading content.
        wanted = tree_items.select(*branches).unionByName(files.select(*branches))
    else:
        # Stored, so that a small selection is broadcast by its measured size.
        chosen = files.join(pinned(select_files(inv, selection).select(*KEYS)), KEYS, "left_semi")
        wanted = selection.select(*branches)
    units = file_units(chosen, strict)
    sections = rendered(units)
    headers = doc_headers(wanted.distinct(), projects, stamp, style, strict)
    listing = tree_listing(tree_items, projects)
    return {
        "inventory": inv,
        "units": units,
        "files": sections,
        "headers": headers,
        "listing": listing,
        "blocks": document_blocks(sections, listing, headers),
        "assets": assets(units),
    }


def _with_inventory_filter(files: DataFrame, large_bytes: int) -> DataFrame:
    """Files that the default selection takes, found row by row without a join."""
    df = with_classes(files)
    selectable = F.when(F.col("is_unknown"), ~looks_binary(F.col("content"))).otherwise(F.col("by_name_selectable"))
    # Names that are also known binaries and files without bytes would be rejected later;
    # keep them visible there.
    small = F.coalesce(file_size(files.columns) < large_bytes, F.lit(True))
    return df.filter(selectable & small).select(*files.columns)

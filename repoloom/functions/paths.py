"""Column expressions on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks used inside sort keys. They sort below every character of a real name, so
# comparing whole keys byte by byte equals comparing the paths level by level.
LEVEL_END, FIRST, SECOND, THIRD = "\x01", "\x02", "\x03", "\x04"


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the last path segment, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)\z", 1))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def is_root_readme(path: Column) -> Column:
    return path.rlike(r"(?is)\Areadme(\.[^/]*)?\z")


def export_sort_key(path: Column) -> Column:
    """Key whose byte order is the export order of normalised paths.

    Per directory: its files by name, then its sub-directories; in the root,
    README files come before the other files. Names compare ignoring case.
    """
    parts = F.split(path, "/")
    folders = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part: F.concat(F.lit(THIRD), F.upper(part), F.lit(LEVEL_END)),
    )
    rank = F.when(is_root_readme(path), F.lit(FIRST)).otherwise(F.lit(SECOND))
    return F.concat(F.array_join(folders, ""), rank, F.upper(F.element_at(parts, -1)))


def asset_path(path: Column, folder: str = "assets") -> Column:
    return F.concat(F.lit(f"{folder}/"), normalize_path(path))


def percent_encode(value: Column) -> Column:
    """RFC 3986 escape: everything but letters, digits and - _ . ~"""
    escaped = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(found), F.lit(wanted))
    return escaped


def asset_link(path: Column, folder: str = "assets") -> Column:
    return F.array_join(F.transform(F.split(asset_path(path, folder), "/"), percent_encode), "/")


def branch_url(web_url: Column, branch: Column, style: str = "flat") -> Column:
    """Link to a branch; `style` names the host's listing style (nested or flat trees)."""
    middle = {"nested": "/tree/", "flat": "/-/tree/"}[style]
    return F.concat(F.regexp_replace(web_url, r"/+\z", ""), F.lit(middle), percent_encode(branch))


def parse_repo_id(repo_id: Column) -> Column:
    """Struct (owner, name, error) from an `owner/name` id; exactly two parts are required."""
    parts = path_parts(F.trim(repo_id, F.lit(WHITE_SPACE)))
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, F.get(parts, F.lit(0))).alias("owner"),
        F.when(ok, F.get(parts, F.lit(1))).alias("name"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("repository id is not owner/name")).alias("error"),
    )


# Every character with the Unicode white-space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def content_urls(base: str, style: str, repo: Column, branch: Column, path: Column) -> dict[str, Column]:
    """Request addresses of one file's repository, as a to-fetch manifest.

    `base` is the address of the API and has to be given by the caller.
    """
    enc, root = percent_encode, F.lit(base.rstrip("/"))
    if style == "nested":
        ident = parse_repo_id(repo)
        home = F.concat(root, F.lit("/repos/"), enc(ident["owner"]), F.lit("/"), enc(ident["name"]))
        file_url = F.concat(home, F.lit("/contents/"), enc(path), F.lit("?ref="), enc(branch))
        return {
            "project_url": home,
            "tree_url": F.concat(home, F.lit("/git/trees/"), enc(branch), F.lit("?recursive=1")),
            "branches_url": F.concat(home, F.lit("/branches?per_page=100&page=1")),
            "raw_url": file_url,
            "metadata_url": file_url,
        }
    home = F.concat(root, F.lit("/projects/"), enc(repo))
    file_url = F.concat(home, F.lit("/repository/files/"), enc(path))
    ref = F.concat(F.lit("?ref="), enc(branch))
    return {
        "project_url": home,
        "tree_url": F.concat(home, F.lit("/repository/tree"), ref, F.lit("&recursive=true&per_page=100&page=1")),
        "branches_url": F.concat(home, F.lit("/repository/branches?per_page=100")),
        "raw_url": F.concat(file_url, F.lit("/raw"), ref),
        "metadata_url": F.concat(file_url, ref),
    }

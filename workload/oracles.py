"""DuckDB SQL for the registered queries, written by other methods where that is possible.

Text is taken apart with RE2 patterns, unnested lists, windows and recursive queries;
none of the Spark expressions is reused, only the fixed values.
"""

from __future__ import annotations

from repoloom.functions import lookups as lk
from workload.views import CODE_FILES, REPO_FILES, SNIFF_BYTES, URL_TREE

ORACLES: dict[str, str] = {}
STEP = 1 << 32
# Characters with the Unicode white-space property, as a DuckDB expression.
WS = " || ".join(
    f"chr({c})"
    for c in [9, 10, 11, 12, 13, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
RF = f"rf AS ({REPO_FILES})"
CF = f"cf AS ({CODE_FILES})"
UT = f"ut AS ({URL_TREE})"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case_map(column: str, mapping: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def name_of(path: str) -> str:
    return rf"regexp_extract({path}, '([^/\\]*)$', 1)"


def ext_of(path: str) -> str:
    return rf"lower(regexp_extract({name_of(path)}, '(\.[^.]+)$', 1))"


# ---------------------------------------------------------------- classification

LANG_EXT = lk.LANGUAGE_BY_EXTENSION
LANG_NAME = {k.lower(): v for k, v in lk.LANGUAGE_BY_NAME.items()}
CLASSED = f"""{RF},
names AS (SELECT *, lower({name_of("path")}) AS nm, {ext_of("path")} AS ext FROM rf),
cls AS (SELECT *,
 ext IN ({quoted(lk.IMAGE_EXTENSIONS)}) AS is_image, ext = '.pdf' AS is_pdf,
 ext IN ({quoted(LANG_EXT)}) OR nm IN ({quoted(LANG_NAME)}) OR nm LIKE '.env%' AS is_text,
 ext IN ({quoted(lk.BINARY_EXTENSIONS)}) AS is_binary,
 coalesce({case_map("nm", LANG_NAME)}, CASE WHEN nm LIKE '.env%' THEN 'bash' END, {case_map("ext", LANG_EXT)}, 'plaintext') AS language
 FROM names)"""

for _id, _expr in {
    "cls_image": "is_image",
    "cls_pdf": "is_pdf",
    "cls_known_text": "is_text",
    "cls_known_binary": "is_binary",
    "cls_selectable": "is_image OR is_pdf OR is_text",
    "cls_unknown": "NOT (is_image OR is_pdf OR is_text OR is_binary)",
}.items():
    ORACLES[_id] = f"WITH {CLASSED} SELECT doc_id, path, {_expr} AS flag FROM cls"

ORACLES["cls_language"] = f"WITH {CLASSED} SELECT doc_id, path, language FROM cls"
ORACLES["text_extensions"] = f"""WITH {CLASSED}, d AS (SELECT ext, {case_map("ext", LANG_EXT)} AS language FROM cls)
SELECT ext, language, count(*) AS n FROM d WHERE language IS NOT NULL GROUP BY 1, 2"""

# Control bytes of the first 4,096 bytes, given as hex digits.
PAIRS = """list_transform(generate_series(0, least(length(hx) // 2, 4096) - 1), lambda i: substr(hx, CAST(i AS INT) * 2 + 1, 2))"""
CONTROLS = f"""len(list_filter({PAIRS}, lambda b: b = '7F' OR (b < '20' AND b NOT IN ('00', '09', '0A', '0C', '0D'))))"""
BINARY = f"""(length(hx) > 0 AND (list_contains({PAIRS}, '00') OR {CONTROLS} * 100 // greatest(least(length(hx) // 2, 4096), 1) > 30))"""
SNIFF = f"sb AS ({SNIFF_BYTES.format(charset='')})"
ORACLES["sniff_binary"] = f"WITH {SNIFF} SELECT doc_id, {BINARY} AS is_binary FROM sb"
ORACLES["control_char_count"] = f"WITH {SNIFF} SELECT doc_id, CAST({CONTROLS} AS BIGINT) AS controls FROM sb"
ORACLES["sample_prefix"] = "SELECT doc_id, left(hex(encode(text)), 8192) AS head FROM documents"

# Inventory in which every seventh file has no readable bytes; large from 1,000 bytes.
INV = f"""{CLASSED},
byt AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN octet_length(encode(content)) END AS n_bytes,
 NOT (is_image OR is_pdf OR is_text OR is_binary) AS is_unknown FROM cls),
inv AS (SELECT *, CASE WHEN is_image THEN 'image' WHEN is_pdf THEN 'pdf' WHEN is_text THEN 'text' WHEN is_binary THEN 'binary' ELSE 'unknown' END AS class,
 CASE WHEN is_unknown THEN n_bytes IS NOT NULL ELSE is_image OR is_pdf OR is_text END AS selectable,
 is_unknown AND n_bytes IS NULL AS failed FROM byt),
inv2 AS (SELECT *, coalesce(n_bytes >= 1000, false) AND selectable AS large FROM inv)"""
ORACLES["inventory"] = f"""WITH {INV} SELECT repo, path, pos, class, language, selectable, coalesce(n_bytes, -1) AS size,
 CASE WHEN failed THEN 'bytes not readable' ELSE '-' END AS error, large FROM inv2"""
ORACLES["inventory_packed"] = ORACLES["inventory"]
ORACLES["node_state"] = f"""WITH {INV} SELECT repo, pos,
 regexp_extract(path, '([^/]*)$', 1) || CASE WHEN failed THEN ' (analyse impossible)' ELSE '' END AS label,
 CASE WHEN selectable THEN 'selectable' WHEN failed THEN 'failed' ELSE 'binary' END AS state,
 CASE WHEN selectable THEN '' WHEN failed THEN 'Analyse du fichier impossible, selection desactivee.' ELSE 'Fichier binaire non exportable.' END AS hint
 FROM inv2"""
ORACLES["large_flag"] = f"WITH {INV} SELECT pos, large FROM inv2"
ORACLES["has_selectable"] = f"WITH {INV} SELECT repo, bool_or(selectable) AS has_selectable FROM inv2 GROUP BY repo"
ORACLES["select_files"] = f"""WITH {INV},
sel AS (SELECT repo, '' AS prefix, false AS explicit FROM rf WHERE doc_id % 20 = 0 UNION
 SELECT repo, 'en/d1', false FROM rf WHERE doc_id % 20 = 1 UNION
 SELECT repo, path, doc_id % 3 = 0 FROM rf WHERE doc_id % 20 >= 2)
SELECT repo, pos, path FROM inv2 i WHERE selectable AND EXISTS (SELECT 1 FROM sel s WHERE s.repo = i.repo
 AND (s.prefix = '' OR i.path = s.prefix OR starts_with(i.path, s.prefix || '/'))
 AND (NOT i.large OR (s.explicit AND s.prefix = i.path)))"""
ORACLES["reject_binary"] = f"""WITH {CLASSED} SELECT doc_id, path, CASE WHEN is_binary THEN 'known binary file'
 WHEN NOT (is_image OR is_pdf OR is_text) AND doc_id % 3 = 0 THEN 'binary content' ELSE '-' END AS reason FROM cls"""
ORACLES["kind_route"] = f"""WITH {CLASSED} SELECT doc_id, path, CASE WHEN is_binary THEN '-' WHEN is_image THEN 'image'
 WHEN is_pdf THEN 'pdf' ELSE 'text' END AS kind FROM cls"""
ORACLES["drop_blank"] = f"SELECT conv_id, turn FROM conversations WHERE turn % 2 <> 0 AND trim(text, {WS}) <> ''"

# ---------------------------------------------------------------- sources

ORACLES["src_files_checkout"] = """SELECT repo, branch, folder, error, line, count(*) AS n, 0::BIGINT AS unread FROM (
 SELECT CASE WHEN i THEN source ELSE '-' END AS repo, CASE WHEN i THEN lang ELSE '-' END AS branch, CASE WHEN i THEN '' ELSE 'elsewhere/source=' || source END AS folder,
  CASE WHEN i THEN '-' ELSE 'outside of the layout' END AS error, unnest(string_split(text, chr(10))) AS line
 FROM (SELECT *, doc_id % 50 <> 0 AS i FROM documents)) GROUP BY ALL"""
ORACLES["src_listing_checkout"] = f"""WITH rf AS ({REPO_FILES}) SELECT repo, branch, doc_id || '/' || path AS path, octet_length(encode(content)) AS size, '-' AS error,
 sha256(content) AS sha FROM rf"""
FLAT = f"""SELECT source AS repo, doc_id * {STEP} + nth AS pos, CASE nth WHEN 0 THEN lang || '/' || doc_id ELSE lang END AS path,
 CASE WHEN doc_id % 5 = 2 THEN '' WHEN nth = 0 THEN 'blob' ELSE 'tree' END AS type, false AS failed
 FROM documents, range(2) r(nth) WHERE doc_id % 5 = 0 OR (doc_id % 5 IN (1, 2) AND nth = 0)"""
ORACLES["src_tree_flat_json"] = f"""{FLAT} UNION ALL
SELECT source, doc_id * {STEP}, '-', '-', true FROM documents WHERE doc_id % 5 = 4"""
ORACLES["union_pages"] = f"""WITH f AS ({FLAT}) SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY pos) AS item_no FROM f"""
ORACLES["src_tree_nested_json"] = f"""
SELECT source AS repo, doc_id * {STEP} + nth AS pos, CASE WHEN nth = 1 THEN lang ELSE lang || '/' || doc_id END AS path,
 CASE WHEN nth = 1 THEN 'tree' ELSE 'blob' END AS type, '-' AS error
 FROM documents, range(3) r(nth) WHERE (doc_id % 5 = 0 AND nth < 2) OR (doc_id % 5 = 3 AND nth = 2)
UNION ALL SELECT source, doc_id * {STEP}, '-', '-', CASE doc_id % 5 WHEN 1 THEN 'tree is truncated' ELSE 'response has no tree array' END
 FROM documents WHERE doc_id % 5 IN (1, 2)"""
ORACLES["src_content_json"] = """SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN text ELSE '-' END AS text,
 CASE doc_id % 6 WHEN 4 THEN 'path is not a file' WHEN 5 THEN 'response has no content' ELSE '-' END AS error FROM documents"""
ORACLES["src_text_utf8"] = """WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 1 THEN text || chr(65533) ELSE text END AS broken,
  regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS plain FROM documents)
SELECT doc_id, '-' AS charset, broken AS text FROM b UNION ALL
SELECT doc_id, ['utf-8', 'ISO-8859-15', 'windows-1252', 'us-ascii', 'utf-16le', 'utf-16be', 'x-unknown'][doc_id % 7 + 1] AS charset,
 CASE doc_id % 7 WHEN 1 THEN plain || chr(8364) || chr(339) WHEN 2 THEN plain || chr(8364) || chr(339) WHEN 3 THEN plain || chr(65533)
  WHEN 4 THEN text WHEN 5 THEN text ELSE broken END AS text FROM b"""
ORACLES["src_size_json"] = """SELECT doc_id, CASE WHEN doc_id % 10 = 4 OR doc_id % 5 = 0 THEN n_chars WHEN doc_id % 5 = 4 THEN 1 ELSE -1 END AS size FROM documents"""
ORACLES["src_project_json"] = """SELECT CAST(p_partkey AS VARCHAR) AS repo,
 CASE WHEN p_partkey % 4 < 2 THEN p_name ELSE '-' END AS name,
 CASE p_partkey % 4 WHEN 0 THEN 'https://h/' || p_partkey WHEN 1 THEN 'https://w/' || p_partkey ELSE '-' END AS web_url,
 CASE p_partkey % 4 WHEN 2 THEN 'response has no address' WHEN 3 THEN 'response has no name' ELSE '-' END AS error FROM part"""
ORACLES["src_branches_json"] = f"""
SELECT p_type AS repo, p_partkey * {STEP} + nth AS pos, CASE nth WHEN 0 THEN 'main' ELSE 'b' || p_partkey END AS name, '-' AS error
 FROM part, range(4) r(nth) WHERE p_partkey % 3 = 0 AND nth IN (0, 3)
UNION ALL SELECT p_type, p_partkey * {STEP}, '-', 'response is not a JSON array' FROM part WHERE p_partkey % 3 = 2"""

# ---------------------------------------------------------------- decoding: the text itself is the expected value

ORACLES["decode_text"] = "SELECT doc_id, text FROM documents"
ORACLES["decode_bom"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '-' END AS text FROM documents"
ORACLES["decode_utf8_strict"] = ORACLES["decode_bom"]
ORACLES["declared_charset"] = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '-'
 ELSE coalesce(nullif(lower(regexp_extract(left(html, 8192), '(?i)charset\\s*=\\s*["'']?([A-Za-z0-9._\\-]+)', 1)), ''), '-') END AS charset FROM pages""".replace("\\\\", "\\")
ORACLES["charset_alias"] = """WITH a AS (SELECT page_id, page_id % 4 AS kind, regexp_replace(html, '[^\\x00-\\x7f]', 'é', 'g') AS t FROM pages)
SELECT page_id, replace(t, 'utf-8', CASE kind WHEN 0 THEN 'latin1' WHEN 1 THEN 'CP1252' WHEN 2 THEN 'no-such' ELSE 'UTF8' END) AS text,
 kind = 2 AND contains(t, 'utf-8') AS unsupported FROM a""".replace("\\\\", "\\")

# ---------------------------------------------------------------- text and path functions


def anchor(text: str) -> str:
    slug = rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{Nd}}_]+', '-', 'g'), '-')"
    return f"coalesce(nullif({slug}, ''), 'section') || '-' || left(sha256({text}), 8)"


def escape(text: str) -> str:
    return rf"regexp_replace({text}, '([\\`*_{{}}\[\]()#+\-!|<>])', '\\\1', 'g')"


def block(lang: str, text: str) -> str:
    return f"CASE WHEN trim({text}, {WS}) = '' THEN '' ELSE '~~~' || {lang} || chr(10) || rtrim({text}, {WS}) || chr(10) || '~~~' || chr(10) || chr(10) END"


ORACLES["md_anchor"] = f"SELECT doc_id, {anchor('text')} AS anchor FROM documents"
ORACLES["md_escape"] = f"SELECT page_id, {escape('html')} AS escaped FROM pages"
ORACLES["md_code_block"] = f"SELECT doc_id, {block('lang', 'text')} AS block FROM documents"
ORACLES["asset_link"] = f"""WITH {RF} SELECT doc_id, replace(url_encode('assets/' || replace(path, chr(92), '/') || ' (é).png'), '%2F', '/') AS link FROM rf"""
ORACLES["pct"] = "SELECT doc_id, url_encode(text) AS escaped FROM documents"
ORACLES["branch_url"] = """SELECT page_id, rtrim(url, '/') || '/tree/' || url_encode('feat/a b~*' || page_id) AS nested,
 rtrim(url, '/') || '/-/tree/' || url_encode('feat/a b~*' || page_id) AS flat FROM pages"""
API = "https://git.example.org/api"
NESTED = f"'{API}/repos/me/' || url_encode(repo)"
FLAT_HOME = f"'{API}/projects/' || url_encode('me/' || repo)"
ORACLES["content_urls"] = f"""WITH {RF} SELECT doc_id, {NESTED} AS nested_project_url,
 {NESTED} || '/git/trees/main?recursive=1' AS nested_tree_url, {NESTED} || '/branches?per_page=100&page=1' AS nested_branches_url,
 {NESTED} || '/contents/' || url_encode(path) || '?ref=main' AS nested_raw_url, {NESTED} || '/contents/' || url_encode(path) || '?ref=main' AS nested_metadata_url,
 {FLAT_HOME} AS flat_project_url, {FLAT_HOME} || '/repository/tree?ref=main&recursive=true&per_page=100&page=1' AS flat_tree_url,
 {FLAT_HOME} || '/repository/branches?per_page=100' AS flat_branches_url,
 {FLAT_HOME} || '/repository/files/' || url_encode(path) || '/raw?ref=main' AS flat_raw_url,
 {FLAT_HOME} || '/repository/files/' || url_encode(path) || '?ref=main' AS flat_metadata_url FROM rf"""
ORACLES["parse_repo_id"] = """WITH a AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['own', 'name']
 ELSE list_filter(string_split(trim(regexp_replace(url, '^https?:/', '')), '/'), lambda p: p <> '') END AS p FROM pages)
SELECT page_id, CASE WHEN len(p) = 2 THEN p[1] ELSE '-' END AS owner, CASE WHEN len(p) = 2 THEN p[2] ELSE '-' END AS name,
 CASE WHEN len(p) = 2 THEN '-' ELSE 'repository id is not owner/name' END AS error FROM a"""
ORACLES["safe_name"] = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '-' WHEN 1 THEN 'inconnu'
 ELSE trim(translate(url, '"<>|:*?/' || chr(92), repeat('-', 9)), ' .') END AS safe FROM pages"""
ORACLES["package_name"] = """SELECT o_orderkey, strftime(o_orderdate, '%y%m%d %H%M%S') || ' ' || o_orderpriority || ' [a-' || o_orderstatus || '].md' AS name FROM orders"""
ORACLES["normalize_path"] = f"WITH {RF} SELECT doc_id, replace(path, chr(92), '/') AS norm FROM rf"
ORACLES["path_parts"] = """WITH a AS (SELECT page_id, list_filter(string_split('/' || replace(url, 'http', '//'), '/'), lambda x: x <> '') AS p FROM pages)
SELECT page_id, nth - 1 AS nth, part FROM (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS nth FROM a)"""
ORACLES["is_root_readme"] = f"""WITH {RF}, a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lower(path) WHEN 1 THEN 'ReadMe' ELSE 'a/' || path END AS p FROM rf)
SELECT doc_id, NOT contains(p, '/') AND (lower(p) = 'readme' OR starts_with(lower(p), 'readme.')) AS is_readme FROM a"""
ORACLES["format_size"] = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber = 3 THEN 'taille inconnue'
 ELSE format('{:.1f} Mo', CAST(trunc(l_extendedprice * 100) AS BIGINT) / 1048576.0::DOUBLE) END AS label FROM lineitem"""
ORACLES["lines"] = f"""WITH {CF}, t AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents UNION ALL SELECT path, content FROM cf),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY n) - length(line) - 1 AS s FROM l)
SELECT path, n - 1 AS line_no, s::BIGINT AS line_start, (s + length(line))::BIGINT AS line_end,
 coalesce(lead(s) OVER (PARTITION BY path ORDER BY n), -1)::BIGINT AS next_start,
 length(line) - length(ltrim(line, ' ' || chr(9))) AS indent, trim(line, {WS}) = '' AS blank FROM o"""

# ---------------------------------------------------------------- ordering and trees

DP = f"{RF}, dp AS (SELECT repo, replace(path, chr(92), '/') AS path, min(pos) AS pos FROM rf GROUP BY 1, 2)"
# The order of the recursion, as a list: directories rank after files on every level.
SORT_KEY = """array_to_string(list_transform(list_slice(string_split(path, '/'), 1, -2), lambda d: chr(4) || upper(d) || chr(1)), '')
 || CASE WHEN NOT contains(path, '/') AND (lower(path) = 'readme' OR starts_with(lower(path), 'readme.')) THEN chr(2) ELSE chr(3) END
 || upper(regexp_extract(path, '([^/]*)$', 1))"""
ORACLES["distinct_paths"] = f"WITH {DP} SELECT repo, path, pos FROM dp"
ORACLES["order_export_files"] = f"WITH {DP} SELECT repo, path, hex(encode({SORT_KEY})) AS sort_key FROM dp"
# Position: all files that come before, counted pair by pair from the rules.
LEVELS = """list_transform(string_split(path, '/'), lambda p, i: [CASE WHEN i < len(string_split(path, '/')) THEN 2
 WHEN len(string_split(path, '/')) = 1 AND (lower(path) = 'readme' OR starts_with(lower(path), 'readme.')) THEN 0 ELSE 1 END::VARCHAR, upper(p)])"""
ORACLES["file_order"] = f"""WITH {DP}, k AS (SELECT *, {LEVELS} AS lv FROM dp)
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY lv, pos) AS file_pos FROM k"""
ORACLES["sort_tree_items"] = f"WITH {UT} SELECT repo, pos, row_number() OVER (PARTITION BY repo ORDER BY upper(path), pos) AS item_pos FROM ut"
NODES = """pre AS (SELECT repo, pos, path, type, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM ut),
ex AS (SELECT repo, pos, path, type, p, CAST(unnest(range(1, len(p) + 1)) AS INT) AS d FROM pre),
nd AS (SELECT repo, upper(array_to_string(list_slice(p, 1, d), '/')) AS node_key, upper(array_to_string(list_slice(p, 1, d - 1), '/')) AS parent_key,
 p[d] AS part, d, d < len(p) OR lower(type) = 'tree' AS dir, row_number() OVER (PARTITION BY repo ORDER BY upper(path), pos, d) AS o FROM ex),
nodes AS (SELECT repo, node_key, parent_key, d::BIGINT AS depth, arg_min(part, o) AS name, bool_or(dir) AS is_dir FROM nd GROUP BY ALL),
sib AS (SELECT *, row_number() OVER (PARTITION BY repo, parent_key ORDER BY is_dir DESC, upper(name)) AS n,
 count(*) OVER (PARTITION BY repo, parent_key) AS c FROM nodes)"""
ORACLES["tree_nodes"] = f"WITH {UT}, {NODES} SELECT repo, node_key, parent_key, name, is_dir, depth FROM nodes"
ORACLES["is_last_child"] = f"WITH {UT}, {NODES} SELECT repo, node_key, n = c AS is_last FROM sib"
ORACLES["sort_tree"] = f"WITH {UT}, {NODES} SELECT repo, node_key, n AS sibling_no FROM sib"
# The listing by recursion from the root downwards.
LISTING = """{nodes}, walk(repo, node_key, is_dir, indent, ord, line) AS (
 SELECT repo, node_key, is_dir, CASE WHEN n = c THEN '    ' ELSE '|   ' END, [n],
  CASE WHEN n = c THEN '\\-- ' ELSE '|-- ' END || name || CASE WHEN is_dir THEN '/' ELSE '' END FROM sib WHERE parent_key = ''
 UNION ALL SELECT s.repo, s.node_key, s.is_dir, w.indent || CASE WHEN n = c THEN '    ' ELSE '|   ' END, list_append(w.ord, s.n),
  w.indent || CASE WHEN n = c THEN '\\-- ' ELSE '|-- ' END || s.name || CASE WHEN s.is_dir THEN '/' ELSE '' END
 FROM walk w JOIN sib s ON s.repo = w.repo AND s.parent_key = w.node_key),
listing AS (SELECT repo, [0] AS ord, {head} || '/' AS line FROM (SELECT DISTINCT repo FROM ut) UNION ALL SELECT repo, ord, line FROM walk)"""
URL_LISTING = LISTING.format(nodes=f"{UT}, {NODES}", head="'P ' || repo")
ORACLES["tree_listing"] = f"WITH RECURSIVE {URL_LISTING} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ord) AS line_no, line FROM listing"
ORACLES["nodes_to_ancestors"] = f"WITH RECURSIVE {URL_LISTING} SELECT repo, line FROM walk WHERE len(ord) > 1"
ORACLES["tree_text"] = f"WITH RECURSIVE {URL_LISTING} SELECT repo, rtrim(string_agg(line, chr(10) ORDER BY ord), {WS}) AS tree_text FROM listing GROUP BY repo"
# The n-th request of a base takes the n-th number whose name is not taken yet.
ORACLES["unique_package_name"] = """WITH b AS (SELECT o_orderkey, o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m') AS base FROM orders),
req AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS nth FROM b),
taken AS (SELECT DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN base ELSE base || ' (' || (o_orderkey % 7 + 2) || ')' END AS name FROM b WHERE o_orderkey % 5 = 0),
cand AS (SELECT base, CAST(k AS BIGINT) AS k, CASE WHEN k = 1 THEN base ELSE base || ' (' || k || ')' END AS name
 FROM (SELECT base, unnest(range(1, count(*) + 10)) AS k FROM b GROUP BY base)),
free AS (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY k) AS nth FROM cand WHERE name NOT IN (SELECT name FROM taken))
SELECT o_orderkey, name AS free_name FROM req JOIN free USING (base, nth)"""

# ---------------------------------------------------------------- functions: lines, tokens and signatures of `src`


def sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Signature patterns and the group that holds the name.
# Languages by k % 7: 0 C#, 1 JavaScript, 2 Java, 3 Python, 4 Lua, 5 PHP, 6 Rust.
RULES = {
    "csharp_method": (0, r"(?m)^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|new|partial|async)\s+)*(?:([\w<>\[\],\s\?]+)\s+)?([@\w]+)\s*\([^;{]*\)\s*\{", 2),
    "csharp_type": (0, r"(?m)^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|file)\s+)*((?:class|struct|interface|record)\s+[@\w]+)[^;{]*\{", 1),
    "js_function": (1, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([\w$]+)\s*\(", 1),
    "js_arrow": (1, r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*=>", 1),
    "js_method": (1, r"(?m)^\s*(?:static\s+)?(?:async\s+)?([\w$]+)\s*\([^)]*\)\s*\{", 1),
    "java": (2, r"(?m)^\s*(?:public|private|protected|static|final|synchronized|abstract|native|\s)+\s*(?:[\w<>\[\], ?\.]+)\s+([A-Za-z_]\w*)\s*\(", 1),
    "python": (3, r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", 1),
    "lua_named": (4, r"(?m)^\s*(?:local\s+)?function\s+([A-Za-z_]\w*(?:[.:][A-Za-z_]\w*)*)\s*\(", 1),
    "lua_assigned": (4, r"(?m)^\s*(?:local\s+)?([A-Za-z_]\w*(?:[.:][A-Za-z_]\w*)*)\s*=\s*function\s*\(", 1),
    "php": (5, r"(?m)^\s*(?:(?:public|private|protected)\s+)?(?:static\s+)?function\s+&?\s*([A-Za-z_]\w*)\s*\([^)]*\)\s*(?::\s*[A-Za-z_\\\|\?\w]+)?\s*\{", 1),
    "rust": (6, r'(?m)^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:"[^"]*"\s+)?)?fn\s+([A-Za-z_]\w*)\s*(?:<[^;\r\n{]*(?:>|\r?\n))?\s*\(', 1),
}
DQ, SQ = r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"
SLASHES = r"//[^\n]*|(?s:/\*.*?\*/)"
TOKEN_RX = {
    0: rf"""{SLASHES}|@"(?:[^"]|"")*"|{DQ}|{SQ}|(?s:.)""",
    1: rf"""{SLASHES}|{DQ}|{SQ}|`(?:[^`\\]|\\.)*`|=>|(?s:.)""",
    5: rf"""{SLASHES}|#[^\n]*|{DQ}|{SQ}|(?s:.)""",
    6: rf"""//[^\n]*|(?s:/\*(?:/\*.*?\*/|.)*?\*/)|{DQ}|'[^A-Za-z_'\\\n][^'\n]*'|'\\.[^'\n]*'|->|(?s:.)""",
    4: rf"""(?s:--\[\[.*?\]\])|--[^\n]*|(?s:\[\[.*?\]\])|{DQ}|{SQ}|[A-Za-z_]\w*|(?s:.)""",
}
KEYWORDS = {
    "csharp_method": "lower(name) IN ('if','for','foreach','while','switch','catch','using','lock','return','throw','do','else','try')",
    "js_method": "lower(name) IN ('if','for','while','switch','catch','function','else','do','try','constructor')",
}


def _rule(rule: str) -> str:
    d, rx, group = RULES[rule]
    return f"""SELECT k, '{rule}' AS rule, {d} AS d, regexp_extract(piece, {sql(rx)}, {group}) AS name, off AS idx, regexp_extract(piece, {sql(rx)}, 0) AS m FROM (
 SELECT *, sum(length(piece)) OVER (PARTITION BY k ORDER BY n) - length(piece) AS off FROM (
  SELECT k, unnest(a) AS piece, generate_subscripts(a, 1) AS n FROM (
   SELECT k, string_split(regexp_replace(content, {sql(rx)}, chr(1) || '\\0', 'g'), chr(1)) AS a FROM src WHERE d = {d}))) WHERE n > 1"""


SRC = CF + ", src AS (SELECT *, CAST(k % 7 AS INT) AS d FROM cf)"
SIGS = "sig0 AS (" + " UNION ALL ".join(_rule(r) for r in RULES) + "), sig AS (SELECT * FROM sig0 WHERE NOT coalesce(CASE rule " + " ".join(
    f"WHEN '{r}' THEN {c}" for r, c in KEYWORDS.items()
) + " END, false))"
TOKS = "tok AS (SELECT k, d, t, n, sum(length(t)) OVER (PARTITION BY k ORDER BY n) - length(t) AS off FROM (" + " UNION ALL ".join(
    f"SELECT k, d, unnest(a) AS t, generate_subscripts(a, 1) AS n FROM (SELECT k, d, regexp_extract_all(content, {sql(rx)}, 0) AS a FROM src WHERE d = {d})"
    for d, rx in TOKEN_RX.items()
) + """)),
lex AS (SELECT k, d, off + length(t) - CASE WHEN t = '->' THEN 1 ELSE length(t) END AS off, CASE WHEN t = '->' THEN '>' ELSE t END AS t FROM tok WHERE CASE d
 WHEN 4 THEN t IN ('function', 'if', 'for', 'while', 'repeat', 'until', 'end') WHEN 6 THEN t IN ('(', ')', '[', ']', '<', '>', '{', '}', ';', '->')
 WHEN 1 THEN t IN ('{', '}', ';', '=>') ELSE t IN ('{', '}') END),
dep AS (SELECT *, sum(step) OVER (PARTITION BY k ORDER BY off) AS depth FROM (
 SELECT *, CASE WHEN t IN ('{', 'function', 'if', 'for', 'while', 'repeat') THEN 1 WHEN t IN ('}', 'until', 'end') THEN -1 END AS step FROM lex) WHERE step IS NOT NULL),
pair AS (SELECT * FROM (SELECT *, lead(off) OVER (PARTITION BY k, level ORDER BY off) AS close_off, lead(t) OVER (PARTITION BY k, level ORDER BY off) AS close_t
 FROM (SELECT *, depth + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level FROM dep)) WHERE step > 0 AND close_off IS NOT NULL)"""
LNS = f"""ln AS (SELECT k, d, n, line, sum(length(line) + 1) OVER (PARTITION BY k ORDER BY n) - length(line) - 1 AS s, trim(line, {WS}) AS t,
 length(line) - length(ltrim(line, ' ' || chr(9))) AS ind FROM (
 SELECT k, d, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM (SELECT k, d, string_split(content, chr(10)) AS a FROM src)))"""
# Where each signature's block ends, by language.
ENDS = r"""pychar AS (SELECT g.k, g.idx, l.n, i, substr(st, CAST(i AS INT), 1) AS c FROM sig g JOIN ln l0 ON l0.k = g.k AND l0.s = g.idx
 JOIN (SELECT *, regexp_replace(regexp_replace(line, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', '', 'g'), '#.*', '') AS st FROM ln) l ON l.k = g.k AND l.n >= l0.n,
 LATERAL (SELECT unnest(range(1, length(st) + 1)) AS i) r WHERE g.rule = 'python'),
pycolon AS (SELECT k, idx, min(n) AS n FROM (SELECT *, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 WHEN c IN (')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY k, idx ORDER BY n, i) AS dp FROM pychar)
 WHERE c = ':' AND dp = 0 GROUP BY 1, 2),
pyend AS (SELECT g.k, g.rule, g.idx, min(l.s) AS e FROM sig g JOIN ln l0 ON l0.k = g.k AND l0.s = g.idx LEFT JOIN pycolon c ON c.k = g.k AND c.idx = g.idx
 LEFT JOIN ln l ON l.k = g.k AND l.n > coalesce(c.n, l0.n) AND l.t <> '' AND l.ind <= l0.ind WHERE g.rule = 'python' GROUP BY 1, 2, 3),
jsmark AS (SELECT g.k, g.rule, g.idx, min(CASE WHEN t = '{' THEN off END) AS brace, min(CASE WHEN t = '=>' THEN off END) AS arrow FROM sig g JOIN tok o ON o.k = g.k AND o.off >= g.idx WHERE g.d = 1 GROUP BY ALL),
jsbody AS (SELECT k, rule, idx, CASE WHEN arrow IS NULL OR brace < arrow THEN brace ELSE (SELECT min(off) FROM tok o WHERE o.k = m.k AND o.off > m.arrow AND trim(t) <> '' AND trim(t, chr(10)) <> ''
  AND t <> '=>' AND NOT regexp_matches(t, '^(//|/\*|["''`])')) END AS body FROM jsmark m),
rscum AS (SELECT *, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS p, sum(CASE t WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS b,
 sum(CASE t WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER w AS a FROM tok WHERE d = 6 WINDOW w AS (PARTITION BY k ORDER BY n)),
rsbody AS (SELECT g.k, g.rule, g.idx, arg_min(o.off, o.off) AS body, arg_min(o.t, o.off) AS t FROM sig g
 LEFT JOIN LATERAL (SELECT p, b, a FROM rscum z WHERE z.k = g.k AND z.off < g.idx ORDER BY z.off DESC LIMIT 1) z ON true
 JOIN rscum o ON o.k = g.k AND o.off >= g.idx AND o.t IN ('{', ';') AND o.p = coalesce(z.p, 0) AND o.b = coalesce(z.b, 0) AND o.a = coalesce(z.a, 0) WHERE g.d = 6 GROUP BY ALL),
opens AS (SELECT k, rule, idx, idx + CASE rule WHEN 'php' THEN instr(m, '{') ELSE length(m) END - 1 AS body FROM sig WHERE d IN (0, 5)
 UNION ALL SELECT k, rule, idx, body FROM jsbody UNION ALL SELECT k, rule, idx, body FROM rsbody WHERE t = '{'
 UNION ALL SELECT g.k, g.rule, g.idx, min(off) FROM sig g JOIN lex x ON x.k = g.k AND x.off >= g.idx WHERE g.d = 4 GROUP BY ALL),
ends AS (SELECT o.k, o.rule, o.idx, o.body, p.close_off + length(p.close_t) AS e FROM opens o JOIN pair p ON p.k = o.k AND p.off = o.body
 UNION ALL SELECT b.k, b.rule, b.idx, b.body, min(x.off) + 1 FROM jsbody b JOIN lex x ON x.k = b.k AND x.off >= b.body AND x.t = ';'
  WHERE NOT EXISTS (SELECT 1 FROM lex y WHERE y.k = b.k AND y.off = b.body AND y.t = '{') GROUP BY ALL
 UNION ALL SELECT y.k, y.rule, y.idx, y.idx, coalesce(y.e, length(s.content)) FROM pyend y JOIN src s USING (k)
 UNION ALL SELECT g.k, g.rule, g.idx, g.idx, coalesce(lead(g.idx) OVER (PARTITION BY g.k ORDER BY g.idx), length(s.content)) FROM sig g JOIN src s USING (k) WHERE g.d = 2)"""
# Walk up from each signature, line by line.
WALK = r"""up(k, d, idx, n, blk, cand) AS (SELECT g.k, g.d, g.idx, l.n, false, g.idx FROM (SELECT DISTINCT k, d, idx FROM sig WHERE d <> 2) g JOIN ln l ON l.k = g.k AND l.s = g.idx
 UNION ALL SELECT k, d, idx, n, CASE dec WHEN 2 THEN true WHEN 3 THEN false ELSE blk END, CASE WHEN dec = 4 THEN cand ELSE s END FROM (
  SELECT w.k, w.d, w.idx, l.n, w.blk, w.cand, l.s, CASE
   WHEN l.t = '' THEN CASE WHEN w.d = 5 THEN 1 ELSE 4 END
   WHEN w.blk THEN CASE WHEN starts_with(l.t, '/*') THEN 3 ELSE 1 END
   WHEN w.d = 3 THEN CASE WHEN starts_with(l.t, '#') THEN 1 ELSE 0 END
   WHEN w.d = 4 THEN CASE WHEN starts_with(l.t, '--') THEN 1 ELSE 0 END
   WHEN w.d = 5 THEN CASE WHEN regexp_matches(l.t, '^(//|#|/\*|\*)') THEN 1 ELSE 0 END
   WHEN w.d = 6 THEN CASE WHEN regexp_matches(l.t, '^(#!?\[|//|/\*)') THEN 1 WHEN starts_with(l.t, '*') OR ends_with(l.t, '*/') THEN 2 ELSE 0 END
   WHEN starts_with(l.t, '//') OR (w.d = 0 AND regexp_matches(l.t, '^\[.*\]$')) OR (w.d = 1 AND starts_with(l.t, '@')) THEN 1
   WHEN ends_with(l.t, '*/') THEN CASE WHEN starts_with(l.t, '/*') THEN 1 ELSE 2 END
   WHEN starts_with(l.t, '*') THEN 1 ELSE 0 END AS dec
  FROM up w JOIN ln l ON l.k = w.k AND l.n = w.n - 1) WHERE dec > 0),
triv AS (SELECT k, idx, min(cand) AS s FROM up GROUP BY 1, 2)"""
SPANS = """raw AS (SELECT g.k, g.rule, g.d, g.name, g.idx, coalesce(t.s, g.idx) AS s, e.body, e.e FROM sig g JOIN ends e ON e.k = g.k AND e.rule = g.rule AND e.idx = g.idx
 LEFT JOIN triv t ON t.k = g.k AND t.idx = g.idx),
leaf AS (SELECT *, rule = 'csharp_type' AND (EXISTS (SELECT 1 FROM raw m WHERE m.k = r.k AND m.rule = 'csharp_method' AND m.s > r.body AND m.s < r.e)
  OR EXISTS (SELECT 1 FROM raw o WHERE o.k = r.k AND o.rule = 'csharp_type' AND o.s > r.body AND o.s < r.e AND o.idx <> r.idx)) AS outer_type FROM raw r),
sp AS (SELECT l.k, path, content, l.d, name, CAST(l.s AS BIGINT) AS s, CAST(l.e AS BIGINT) AS e, row_number() OVER (PARTITION BY l.k ORDER BY CASE WHEN l.d = 0 THEN l.s ELSE l.idx END, l.e, l.rule) - 1 AS emit_pos
 FROM leaf l JOIN src USING (k) WHERE NOT outer_type AND l.e > l.s)"""
LEXED = f"{SRC}, {SIGS}, {TOKS}, {LNS}, {ENDS}"
FUNCS = f"{LEXED}, {WALK}, {SPANS}"

for _id, _rule_name in {
    "sig_csharp_method": "csharp_method", "sig_js_function": "js_function", "sig_js_arrow": "js_arrow", "sig_js_method": "js_method",
    "sig_java": "java", "sig_python": "python", "sig_lua_named": "lua_named", "sig_lua_assigned": "lua_assigned", "sig_php": "php", "sig_rust": "rust",
}.items():
    ORACLES[_id] = f"WITH {SRC}, {SIGS} SELECT path, rule, name, CAST(idx AS BIGINT) AS idx FROM sig JOIN src USING (k) WHERE rule = '{_rule_name}'"
ORACLES["union_candidates"] = f"WITH {SRC}, {SIGS} SELECT path, rule, name, CAST(idx AS BIGINT) AS idx FROM sig g JOIN src USING (k) WHERE g.d IN (1, 4)"
ORACLES["distinct_candidates"] = f"WITH {SRC}, {SIGS} SELECT DISTINCT path, name, CAST(idx AS BIGINT) AS idx FROM sig g JOIN src USING (k) WHERE g.d = 1"
for _id, _d in {"lex_csharp": 0, "lex_js": 1, "lex_php": 5, "lex_rust": 6, "lex_lua": 4}.items():
    ORACLES[_id] = f"WITH {SRC}, {TOKS} SELECT path, CAST(off AS BIGINT) AS off, t AS token FROM lex x JOIN src USING (k) WHERE x.d = {_d}"
ORACLES["brace_depth"] = f"WITH {SRC}, {TOKS} SELECT path, CAST(off AS BIGINT) AS off, t AS token, CAST(depth AS BIGINT) AS depth FROM dep JOIN src USING (k)"
ORACLES["match_brace"] = f"WITH {SRC}, {TOKS} SELECT path, CAST(off AS BIGINT) AS open_off, CAST(close_off AS BIGINT) AS close_off FROM pair JOIN src USING (k)"
for _id, _cond in {
    "js_statement_end": "g.rule = 'js_arrow'", "py_block_end": "g.d = 3",
}.items():
    ORACLES[_id] = f"""WITH {LEXED} SELECT path, name, CAST(g.idx AS BIGINT) AS idx, CAST(coalesce(e.e, -1) AS BIGINT) AS end_pos FROM sig g JOIN src USING (k)
 LEFT JOIN ends e ON e.k = g.k AND e.rule = g.rule AND e.idx = g.idx WHERE {_cond}"""
BODY = f"""WITH {LEXED} SELECT path, name, CAST(g.idx AS BIGINT) AS idx, CAST(coalesce(o.body, -1) AS BIGINT) AS body_pos FROM sig g JOIN src USING (k)
 LEFT JOIN opens o ON o.k = g.k AND o.rule = g.rule AND o.idx = g.idx"""
ORACLES["js_body"], ORACLES["rust_body"] = f"{BODY} WHERE g.d = 1", f"{BODY} WHERE g.d = 6"
ORACLES["open_brace_of_signature"] = f"{BODY} WHERE g.d IN (1, 5, 6) AND substr(content, CAST(o.body AS INT) + 1, 1) = '{{'"
ORACLES["py_signature_end"] = f"""WITH {LEXED} SELECT path, name, CAST(g.idx AS BIGINT) AS idx, CAST(l.s + length(l.line) + 1 AS BIGINT) AS body_pos
 FROM sig g JOIN src USING (k) JOIN pycolon c ON c.k = g.k AND c.idx = g.idx JOIN ln l ON l.k = g.k AND l.n = c.n WHERE g.d = 3"""
ORACLES["fn_spans"] = f"WITH RECURSIVE {FUNCS} SELECT path, emit_pos, name, s AS start_pos, e AS end_pos FROM sp"
for _id, _d in {"until_next": 2, "lua_block_end": 4, "indent_block_end": 3, "union_methods_types": 0}.items():
    ORACLES[_id] = f"WITH RECURSIVE {FUNCS} SELECT path, name, s AS start_pos, e AS end_pos FROM sp WHERE d = {_d}"
ORACLES["fn_names"] = f"""WITH RECURSIVE {FUNCS}, nm AS (SELECT k, name, idx AS o FROM sig WHERE rule = 'csharp_method'
 OR (rule = 'java' AND name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'throw', 'do'))
 UNION ALL SELECT k, name, emit_pos FROM sp WHERE d NOT IN (0, 2))
SELECT path, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS emit_pos, name FROM nm JOIN src USING (k)"""
ORACLES["leading_trivia"] = f"WITH RECURSIVE {FUNCS} SELECT path, name, CAST(s AS BIGINT) AS start_pos FROM raw r JOIN src USING (k) WHERE r.d <> 2"
TYPES = f"""WITH RECURSIVE {FUNCS}, ty AS (SELECT r.*, path,
 EXISTS (SELECT 1 FROM raw m WHERE m.k = r.k AND m.rule = 'csharp_method' AND m.s > r.body AND m.s < r.e) AS has_method,
 EXISTS (SELECT 1 FROM raw m WHERE m.k = r.k AND m.rule = 'csharp_type' AND m.idx <> r.idx AND m.s > r.body AND m.s < r.e) AS has_type
 FROM raw r JOIN src USING (k) WHERE rule = 'csharp_type')
SELECT path, name, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos"""
ORACLES["sig_csharp_type"] = f"{TYPES}, NOT has_method AND NOT has_type AS is_leaf FROM ty"
ORACLES["type_leaf_anti_method"] = f"{TYPES} FROM ty WHERE NOT has_method"
ORACLES["type_leaf_anti_type"] = f"{TYPES} FROM ty WHERE NOT has_type"
ORACLES["valid_spans"] = f"""WITH RECURSIVE {FUNCS} SELECT path, name, s - emit_pos * 20 AS start_pos, e + emit_pos * 20 AS end_pos FROM sp
 WHERE s - emit_pos * 20 >= 0 AND e + emit_pos * 20 <= length(content)"""
ORACLES["sort_spans"] = f"WITH RECURSIVE {FUNCS} SELECT path, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, emit_pos) - 1 AS nth, name FROM sp"
DIALECT = {"csharp": "csharp", "javascript": "js", "typescript": "js", "java": "java", "python": "python", "lua": "lua", "php": "php", "rust": "rust"}
CODE_LANG = "CASE k % 7 WHEN 0 THEN 'csharp' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'python' WHEN 4 THEN 'lua' WHEN 5 THEN 'php' ELSE 'rust' END"
ORACLES["fn_dispatch"] = f"""WITH {CF}, {CLASSED}, a AS (SELECT {CODE_LANG} AS language, true AS known FROM cf
 UNION ALL SELECT language, is_image OR is_pdf OR is_text OR is_binary FROM cls)
SELECT language, coalesce(CASE WHEN known THEN {case_map("language", DIALECT)} END, '-') AS dialect, count(*) AS n FROM a GROUP BY 1, 2"""
ORACLES["files_to_spans"] = f"""WITH RECURSIVE {FUNCS}, {CLASSED}, a AS (SELECT {CODE_LANG} AS language, coalesce(c, 0) AS c FROM src LEFT JOIN (SELECT k, count(*) AS c FROM sp GROUP BY k) USING (k)
 UNION ALL SELECT language, 0 FROM cls WHERE NOT is_binary AND NOT is_image AND NOT is_pdf)
SELECT language, count(*) AS files, sum(c)::BIGINT AS functions FROM a GROUP BY 1"""

# ---------------------------------------------------------------- outline and documents


def outline_ctes(spans: str) -> str:
    """Nesting of `spans` (k, path, name, s, e, emit_pos): the parent is the latest earlier container."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, emit_pos) AS ord FROM {spans}),
par AS (SELECT c.k, c.ord, coalesce(max(p.ord), 0) AS parent_ord FROM o c LEFT JOIN o p ON p.k = c.k AND p.ord < c.ord AND p.s <= c.s AND p.e >= c.e AND (p.s < c.s OR p.e > c.e) GROUP BY 1, 2),
qn(k, ord, parent_ord, depth, q) AS (SELECT k, ord, 0::BIGINT, 0::BIGINT, name FROM o JOIN par USING (k, ord) WHERE par.parent_ord = 0
 UNION ALL SELECT p.k, p.ord, p.parent_ord, q.depth + 1, q.q || '.' || o.name FROM qn q JOIN par p ON p.k = q.k AND p.parent_ord = q.ord JOIN o ON o.k = p.k AND o.ord = p.ord),
ent AS (SELECT o.*, qn.parent_ord, qn.depth, qn.q, row_number() OVER (PARTITION BY o.k, upper(qn.q) ORDER BY o.ord) AS occ FROM o JOIN qn USING (k, ord)),
lab AS (SELECT *, q || CASE WHEN occ > 1 THEN ' (' || occ || ')' ELSE '' END AS display FROM ent)"""


OUT = f"{FUNCS}, {outline_ctes('sp')}"
FN_ANCHOR = anchor("('fn::' || path || '::' || q || '::' || s)")
ORACLES["outline"] = f"""WITH RECURSIVE {OUT} SELECT path, ord, parent_ord, depth, q AS qualified_name, display AS display_name,
 {FN_ANCHOR} AS anchor, s AS start_pos, e AS end_pos FROM lab"""
ORACLES["outline_preorder"] = f"WITH RECURSIVE {OUT} SELECT path, ord, display AS display_name FROM lab"
TWICE = OUT.replace(
    "src AS (SELECT *, CAST(k % 7 AS INT) AS d FROM cf)",
    "src AS (SELECT * REPLACE (CASE WHEN k % 7 IN (4, 5) THEN content || chr(10) || upper(content) || chr(10) || content ELSE content END AS content), CAST(k % 7 AS INT) AS d FROM cf)",
)
ORACLES["occurrence_label"] = f"WITH RECURSIVE {TWICE} SELECT path, ord, q AS qualified_name, display AS display_name FROM lab"
ITEMS = """li AS (SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS VARCHAR) AS name, l_linenumber * 3 AS s,
 l_linenumber * 3 + CAST(l_quantity AS INT) AS e, l_linenumber AS emit_pos FROM lineitem)"""
ORACLES["span_parent"] = f"WITH RECURSIVE {ITEMS}, {outline_ctes('li')} SELECT path, name, ord, parent_ord, q AS qualified_name FROM lab"
# Pieces of a file; the sort key is (entry, place, deepest container first).
SEGS = f"""kid AS (SELECT *, lag(e) OVER (PARTITION BY k, parent_ord ORDER BY ord) AS prev_e, lead(depth) OVER (PARTITION BY k ORDER BY ord) AS next_depth FROM lab),
box AS (SELECT k, ord, s, e, depth FROM lab WHERE EXISTS (SELECT 1 FROM par WHERE par.k = lab.k AND par.parent_ord = lab.ord)
 UNION ALL SELECT k, 0, 0, length(content), -1 FROM src),
lastkid AS (SELECT b.k, b.ord, arg_max(c.e, c.ord) AS last_e FROM box b LEFT JOIN lab c ON c.k = b.k AND c.parent_ord = b.ord GROUP BY 1, 2),
desc_of AS (SELECT b.k, b.ord, coalesce(max(c.ord), 0) AS last_ord FROM box b LEFT JOIN lab c ON c.k = b.k AND c.ord >= b.ord
  AND NOT EXISTS (SELECT 1 FROM lab x WHERE x.k = b.k AND x.ord > b.ord AND x.ord <= c.ord AND x.depth <= b.depth) GROUP BY 1, 2),
seg AS (SELECT c.k, [c.ord, -1, 0] AS key, 'gap' AS kind, c.ord, coalesce(prev_e, b.s) AS a, c.s AS z FROM kid c JOIN box b ON b.k = c.k AND b.ord = c.parent_ord WHERE c.s > coalesce(prev_e, b.s)
 UNION ALL SELECT k, [ord, 0, 0], 'heading', ord, s, e FROM kid
 UNION ALL SELECT k, [ord, 1, 0], 'body', ord, s, e FROM kid WHERE coalesce(next_depth, 0) <= depth
 UNION ALL SELECT b.k, [x.last_ord, 2, -b.depth], 'tail', b.ord, coalesce(l.last_e, b.s), b.e FROM box b JOIN lastkid l USING (k, ord) JOIN desc_of x USING (k, ord) WHERE coalesce(l.last_e, b.s) < b.e)"""
SEG = f"{OUT}, {SEGS}"
ORACLES["segment_gaps"] = f"""WITH RECURSIVE {SEG} SELECT path, kind, CAST(a AS BIGINT) AS start_pos, CAST(z AS BIGINT) AS end_pos FROM seg JOIN src USING (k) WHERE kind IN ('gap', 'tail')"""
CODE = "substr(content, CAST(a AS INT) + 1, CAST(z - a AS INT))"
ORACLES["code_segments"] = f"""WITH RECURSIVE {SEG} SELECT path, kind, CAST(ord AS BIGINT) AS ord, CASE WHEN kind = 'heading' THEN '-' ELSE {CODE} END AS code FROM seg JOIN src USING (k)
 WHERE kind = 'heading' OR trim({CODE}, {WS}) <> ''"""
NL = "chr(10)"
FILE_ANCHOR = anchor("('file-' || path)")
HEAD_LINE = f"""'<a name="' || {FN_ANCHOR} || '"></a>' || {NL} || '#### ' || {escape('display')} || {NL} || {NL}"""
RENDER = f"""tocs AS (SELECT s.k, any_value(s.repo) AS repo, any_value(s.path) AS path, '- [' || {escape('any_value(s.path)')} || '](#' || {anchor("('file-' || any_value(s.path))")} || ')' || {NL} ||
  coalesce(string_agg(CASE WHEN ord IS NOT NULL THEN '  - [' || {escape('display')} || '](#' || {FN_ANCHOR.replace("path", "s.path").replace("|| s)", "|| l.s)")} || ')' || {NL} END, '' ORDER BY ord), '') AS toc FROM src s LEFT JOIN lab l USING (k) GROUP BY s.k),
heads AS (SELECT k, ord, {HEAD_LINE} AS txt FROM lab),
bodies AS (SELECT g.k, string_agg(CASE WHEN kind = 'heading' THEN h.txt ELSE {block(CODE_LANG.replace("k %", "g.k %"), CODE)} END, '' ORDER BY key) AS body FROM seg g JOIN src s ON s.k = g.k LEFT JOIN heads h ON h.k = g.k AND h.ord = g.ord GROUP BY 1),
secs AS (SELECT s.k, repo, path, '<a name="' || {FILE_ANCHOR} || '"></a>' || {NL} || '### ' || {escape('path')} || {NL} || {NL} || coalesce(body, '') AS section FROM src s LEFT JOIN bodies USING (k))"""
ORACLES["toc"] = f"WITH RECURSIVE {OUT}, {RENDER.split('heads AS')[0].rstrip().rstrip(',')} SELECT path, toc FROM tocs"
ORACLES["file_section"] = f"WITH RECURSIVE {SEG}, {RENDER} SELECT path, section FROM secs"


def header(name: str) -> str:
    package = f"('240506 070809 ' || {name} || ' [main].md')"
    return f"""'# ' || {escape(name)} || {NL} || {NL} || 'Branche du depot : [main](https://git.example.org/' || repo || '/-/tree/main)' || {NL} || {NL}
 || '## ' || {escape(package)} || {NL} || {NL} || '## Arborescence' || {NL} || {NL} || '~~~text' || {NL}"""


TREE_END = f"'~~~' || {NL} || {NL} || '## Table des matieres' || {NL} || {NL}"
ORACLES["doc_header"] = f"""WITH {CF} SELECT repo, '240506 070809 ' || repo || ' #1 [main].md' AS file_name, {header("(repo || ' #1')")} AS header FROM (SELECT DISTINCT repo FROM cf)"""


def document(ctes: str, name: str, toc: str, section: str, files: str) -> str:
    """One text per repository from a tree `listing` and per-file `toc` and `section` texts."""
    return f"""{ctes},
toc_of AS (SELECT repo, string_agg(toc, '' ORDER BY lv, path) AS t FROM (SELECT repo, path, {LEVELS} AS lv, {toc} AS toc FROM {files}) GROUP BY 1),
sec_of AS (SELECT repo, string_agg(section, '' ORDER BY lv, path) AS t FROM (SELECT repo, path, {LEVELS} AS lv, {section} AS section FROM {files}) GROUP BY 1),
tree_of AS (SELECT repo, string_agg(line || {NL}, '' ORDER BY ord) AS t FROM listing GROUP BY 1),
docs AS (SELECT repo, {header(name)} || tree_of.t || {TREE_END} || toc_of.t || {NL} || sec_of.t AS text FROM tree_of JOIN toc_of USING (repo) JOIN sec_of USING (repo))"""


CODE_UT = "ut AS (SELECT k AS pos, repo, branch, path, 'blob' AS type FROM cf)"
CODE_LISTING = LISTING.format(nodes=f"{CODE_UT}, {NODES}", head="repo || ' #1'")
CODE_DOC = document(f"{SEG}, {RENDER}, rendered AS (SELECT secs.repo, secs.path, section, toc FROM secs JOIN tocs USING (k)), {CODE_LISTING}", "(repo || ' #1')", "toc", "section", "rendered")
ORACLES["merge_corpus"] = f"""WITH RECURSIVE {CODE_DOC}, l AS (SELECT repo, string_split(left(text, length(text) - 1), {NL}) AS a FROM docs)
SELECT repo, generate_subscripts(a, 1) AS line_no, unnest(a) AS text FROM l"""

# Mixed repositories: prose in files of every class, each path once, no functions.
MIXED = f"""{CLASSED}, one AS (SELECT * FROM cls WHERE pos = (SELECT min(pos) FROM cls c WHERE c.repo = cls.repo AND c.path = cls.path)),
ut AS (SELECT pos, repo, branch, replace(path, chr(92), '/') AS path, 'blob' AS type FROM one),
exported AS (SELECT repo, replace(path, chr(92), '/') AS path, content, language, is_image, is_pdf FROM one WHERE NOT is_binary)"""
LINK = f"'[' || {escape(name_of('path'))} || '](' || replace(url_encode('assets/' || path), '%2F', '/') || ')' || {NL} || {NL}"
MIXED_SECTION = f"""'<a name="' || {FILE_ANCHOR} || '"></a>' || {NL} || '### ' || {escape('path')} || {NL} || {NL}
 || CASE WHEN is_image THEN '!' || {LINK} WHEN is_pdf THEN {LINK} ELSE {block('language', 'content')} END"""
MIXED_TOC = f"'- [' || {escape('path')} || '](#' || {FILE_ANCHOR} || ')' || {NL}"
MIXED_DOC = document(LISTING.format(nodes=f"{MIXED}, {NODES}", head="'My_' || repo"), "('My_' || repo)", MIXED_TOC, MIXED_SECTION, "exported")
ORACLES["merged_document"] = f"WITH RECURSIVE {MIXED_DOC} SELECT repo, 0::BIGINT AS piece, text FROM docs"
ORACLES["sink_markdown"] = f"""WITH RECURSIVE {MIXED_DOC}, cut AS (SELECT repo, string_split(left(text, length(text) - 1), {NL}) AS lines FROM docs)
SELECT repo, 'main' AS branch, '240506 070809 My_' || repo || ' [main]' AS package, '240506 070809 My_' || repo || ' [main].md' AS file_name,
 unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS text FROM cut"""
ORACLES["sink_assets"] = f"""WITH {MIXED} SELECT repo, path, 'assets/' || path AS asset_path, octet_length(encode(content)) AS bytes FROM exported WHERE is_image OR is_pdf"""

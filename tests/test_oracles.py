"""Registered queries against DuckDB on the given tables.

All of them with TEST_ORACLES=all; otherwise one of each kind.
"""

import os

import duckdb
import pytest

from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SOME = """cls_language inventory select_files decode_text charset_alias md_anchor content_urls lines file_order tree_listing
unique_package_name src_tree_flat_json src_content_json sniff_binary fn_names fn_spans match_brace outline span_parent
code_segments merge_corpus sink_markdown js_body rust_body open_brace_of_signature
src_listing_checkout inventory_packed tree_text""".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(pdf):
    return sorted(tuple(map(str, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("TEST_ORACLES") == "all" else SOME)
def test_query(spark, sf, duck, name):
    got, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0 and rows(got) == rows(expected)

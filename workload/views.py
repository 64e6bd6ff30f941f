"""Inputs derived from the given tables by SQL that Spark and DuckDB run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repoloom.session import spread

CODE_FILES = r"""
SELECT k, repo, branch, path, replace(replace(tpl, '~', chr(10)), '@k', cast(k AS varchar(20))) AS content FROM (
 SELECT p_partkey AS k, p_type AS repo, 'main' AS branch,
  replace(CASE p_partkey % 7 WHEN 0 THEN 'src/Parts/Part@k.cs' WHEN 1 THEN 'web/app@k.js' WHEN 2 THEN 'java/P@k.java' WHEN 3 THEN 'py/mod@k.py' WHEN 4 THEN 'lua/m@k.lua' WHEN 5 THEN 'php/c@k.php' ELSE 'rs/l@k.rs' END, '@k', cast(p_partkey AS varchar(20))) AS path,
  CASE p_partkey % 7
  WHEN 0 THEN 'using System;~namespace Demo {~  // calc @k~  public class Part@k {~    [Obsolete]~    public int Area(int w) {~      if (w > 0) { return w; }~      return @k; // }~    }~~    /* block~     * two */~    private static string Name() { return "{@k}"; }~  }~  public struct P@k { int x; }~}~'
  WHEN 1 THEN '// head~export function run@k(a) {~  function inner(b) { return b + "}"; }~  return inner(a);~}~const sq@k = (x) => x * x;~class K {~  static go(a) {~    return a;~  }~}~'
  WHEN 2 THEN 'public class P@k {~    public int area(int w) {~        return w;~    }~    private static void log@k() {~    }~}~'
  WHEN 3 THEN 'import os~~# note @k~def outer@k(a,~          b={1: 2}):~    # body~    def inner(c):~        return c~~    return inner(a)~~async def tail@k():~    pass~'
  WHEN 4 THEN 'local M = {}~-- doc~function M.f@k(a)~  if a then return "end" end~  for i = 1, 2 do a = a + i end~  return a~end~M.g = function(b) return b end~'
  WHEN 5 THEN '<?php~class C@k {~  // doc~  public static function make@k($a): ?string {~    return "}"; # }~  }~}~'
  ELSE '/// doc~#[inline]~pub fn f@k<T: Into<u32>>(x: T) -> u32 {~    /* { /* } */ */~    let c = ''{'';~    x.into()~}~trait T@k {~    fn sig(&self);~}~' END AS tpl
 FROM part) s
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    df.createOrReplaceTempView(name)
    return df


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small source files in seven dialects, one per row of `part`."""
    table(spark, sf_dir, "part")
    return spark.sql(CODE_FILES)


REPO_FILES = r"""
SELECT doc_id, source AS repo, 'main' AS branch, doc_id AS pos, text AS content,
 CASE x % 20 WHEN 0 THEN 'README.md' ELSE concat(lang, '/d', cast(x % 3 AS varchar(20)), '/', CASE x % 20
  WHEN 1 THEN 'Dockerfile' WHEN 2 THEN '.env.production'
  WHEN 3 THEN concat('a', cast(doc_id AS varchar(20)), '.py') WHEN 4 THEN concat('A', cast(doc_id AS varchar(20)), '.TS')
  WHEN 5 THEN concat('img', cast(doc_id AS varchar(20)), '.svg') WHEN 6 THEN concat('img', cast(doc_id AS varchar(20)), '.PNG')
  WHEN 7 THEN concat('doc', cast(doc_id AS varchar(20)), '.pdf') WHEN 8 THEN concat('lib', cast(doc_id AS varchar(20)), '.dll')
  WHEN 9 THEN '.env.zip' WHEN 10 THEN concat('data', cast(doc_id AS varchar(20)), '.foo')
  WHEN 11 THEN concat('noext', cast(doc_id AS varchar(20))) WHEN 12 THEN '.gitignore' WHEN 13 THEN 'CMakeLists.txt'
  WHEN 14 THEN concat('x', cast(doc_id AS varchar(20)), '.cs') WHEN 15 THEN concat('y', cast(doc_id AS varchar(20)), '.tar.gz')
  WHEN 16 THEN concat('z', cast(doc_id AS varchar(20)), '.') WHEN 17 THEN concat('w', cast(doc_id AS varchar(20)), '.vue')
  WHEN 18 THEN concat('page', cast(doc_id AS varchar(20)), '.html')
  ELSE concat('back', chr(92), 'slash', cast(doc_id AS varchar(20)), '.md') END) END AS path
FROM (SELECT doc_id, source, lang, text, cast(floor(doc_id / 20) AS bigint) AS x FROM documents) s
"""

# Host and path of each page address.
URL_TREE = r"""
SELECT page_id AS pos, 'main' AS branch, CASE WHEN page_id % 10 = 9 THEN 'commit' ELSE 'blob' END AS type,
 regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?#].*$', '') AS repo,
 regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS path
FROM pages
"""

# Bytes (hex) of whole texts. Of the first n = least(4096, size) bytes the first 0, floor(30 % of n) or ceiling(31 % of n) are
# replaced by byte 1; or one byte by 0, the last of the sample or, where there is one, the first behind it.
SNIFF_BYTES = r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN hx WHEN 1 THEN concat(repeat('01', n30), substring(hx, 2 * n30 + 1))
 WHEN 2 THEN concat(repeat('01', n31), substring(hx, 2 * n31 + 1))
 ELSE concat(substring(hx, 1, 2 * z), '00', substring(hx, 2 * z + 3)) END AS hx
FROM (SELECT doc_id, hx, cast(floor(n * 30 / 100) AS int) AS n30, cast(ceil(n * 31 / 100) AS int) AS n31,
  CASE WHEN doc_id % 8 = 3 AND length(hx) > 8192 THEN 4096 WHEN n > 0 THEN n - 1 ELSE 0 END AS z
 FROM (SELECT doc_id, hx, cast(least(4096, length(hx) / 2) AS int) AS n FROM (SELECT doc_id, hex(encode(text{charset})) AS hx FROM documents) a) b) s
"""


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with names of every class, one per document."""
    table(spark, sf_dir, "documents")
    return spark.sql(REPO_FILES)


def url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages")
    return spark.sql(URL_TREE)


def sniff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents")
    return spark.sql(SNIFF_BYTES.format(charset=", 'UTF-8'"))

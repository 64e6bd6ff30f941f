"""Golden values of text, path, charset and classification expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from repoloom.functions import charset as cs
from repoloom.functions import paths as fp
from repoloom.functions import text as ft
from repoloom.operators import classify


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def from_bytes(spark, value, column):
    return spark.createDataFrame([(bytearray(value),)], "x binary").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value, column, expected",
    [
        ("a_b*[x]", ft.md_escape, r"a\_b\*\[x\]"),
        ("feat/a b~*é+", fp.percent_encode, "feat%2Fa%20b~%2A%C3%A9%2B"),
        ("fn::Src/É.cs::A.b::12", ft.md_anchor, "fn-src-é-cs-a-b-12-834ec8e6"),
        (" \t", ft.md_anchor, "section"),
        ("***", ft.md_anchor, None),
        ("x.tar.GZ", fp.extension, ".gz"),
        ("a/.gitignore", fp.extension, ".gitignore"),
        ("a.b/c.", fp.extension, ""),
        (r"a\b.TS", fp.extension, ".ts"),
        ("Readme.de.md", fp.is_root_readme, True),
        ("readmes", fp.is_root_readme, False),
        ("a/README.md", fp.is_root_readme, False),
        ('a<b>:"|?*', ft.safe_name, "a-b------"),
        (" .. ", ft.safe_name, "inconnu"),
        (None, ft.safe_name, "inconnu"),
    ],
)
def test_text(spark, value, column, expected):
    got = one(spark, value, column)
    assert got == expected if expected is not None else got.startswith("section-")


def test_package_name(spark):
    stamp = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9)).cast("timestamp_ntz")
    got = one(spark, "p/q", lambda x: ft.package_name(stamp, x, F.lit("feat:1")))
    assert got == "240506 070809 p-q [feat-1].md"


@pytest.mark.parametrize(
    "value, expected",
    [
        (b"", False),
        (b"\x01" * 30 + b"a" * 70, False),
        (b"\x01" * 31 + b"a" * 69, True),
        (b"a\x00", True),
        (b"\t\n\r\x0c" * 50, False),
        (b"\xff" * 50, False),
        (b"a" * 4096 + b"\x00" * 100, False),
    ],
)
def test_looks_binary(spark, value, expected):
    assert from_bytes(spark, value, cs.looks_binary) is expected


@pytest.mark.parametrize(
    "value, path, expected",
    [
        (b"", "a.txt", ""),
        (b"\xef\xbb\xbfa\xc3", "a.txt", "a�"),
        (b"\xff\xfe\x00\x00a\x00\x00\x00", "a.txt", "a"),
        (b"\xff\xfea\x00\x00", "a.txt", "a�"),
        (b"\xff\xfe\x00\xd8a\x00", "a.txt", "�a"),
        (b"\xff\xfe\x3d\xd8\x00\xde", "a.txt", "\U0001f600"),
        (b"\xfe\xff\x00a\xdc\x00", "a.txt", "a�"),
        (b"\xff\xfe\x00\x00\x00\xd8\x00\x00a\x00\x00\x00\x01", "a.txt", "�a�"),
        (b"\xe9", "a.txt", "é"),
        ("é".encode(), "a.txt", "é"),
        (b"<meta charset=cp1252>\x80", "a.HTML", "<meta charset=cp1252>€"),
        (b"<meta charset=cp1252>\x80", "a.txt", "<meta charset=cp1252>\x80"),
        (b"<?xml encoding='latin1'?>\xc3\xa9", "a.xml", "<?xml encoding='latin1'?>Ã©"),
        (b"<?xml encoding='koi8-r'?>\xc3\xa9", "a.xml", "<?xml encoding='koi8-r'?>é"),
        (b"<meta charset=utf-8>\xff", "a.htm", "<meta charset=utf-8>�"),
        ("﻿﻿x".encode(), "a.txt", "x"),
    ],
)
def test_decode_text(spark, value, path, expected):
    assert from_bytes(spark, value, lambda c: cs.decode_text(c, F.lit(path))) == expected


def test_classes(spark):
    names = {
        ".env.zip": ("text", True, "bash", "known binary file"),
        ".env.png": ("image", False, "bash", None),
        "a/Dockerfile": ("text", False, "docker", None),
        "CMakeLists.TXT": ("text", False, "cmake", None),
        "x.dll": ("binary", True, "plaintext", "known binary file"),
        "x.svg": ("image", False, "plaintext", None),
        "x.pdf": ("pdf", False, "plaintext", None),
        "x.unknown": ("unknown", False, "plaintext", "binary content"),
    }
    files = spark.createDataFrame([(n, bytearray(b"\x00")) for n in names], "path string, content binary")
    got = classify.with_kind(classify.with_classes(files)).withColumn("class", classify.file_class())
    rows = {r["path"]: (r["class"], r["is_known_binary"], r["language"], r["reason"]) for r in got.collect()}
    assert rows == names


def test_strict_fails(spark):
    files = spark.createDataFrame([("a.exe", bytearray(b""))], "path string, content binary")
    with pytest.raises(Exception, match="a.exe"):
        classify.with_kind(classify.with_classes(files), strict=True).collect()


def test_classes_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a.py",)], "path string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    run = classify.with_classes(stream).writeStream.format("memory").queryName("classes").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("classes").first()["language"] == "python"

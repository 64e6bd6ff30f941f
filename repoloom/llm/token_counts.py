"""Token counts kept up to date by signed deltas.

A change says that a document's count under a tokenizer version was inserted, revised or
deleted. What holds for a document and version is its last change, by batch number and then by `seq`. A batch is
joined to the ledger (the last change of each document and version so far), becomes signed rows (minus the old count,
plus the new one), and these are summed by source, language and version into the batch's delta, on the map
side first. Totals are sums of deltas.

Batches may come in any order: a change of a lower batch than the ledger's is late and moves nothing, so the totals are
those of counting anew whatever came when. Commits are idempotent: a batch writes its ledger rows, then its delta, under its
own number; a batch whose delta is complete is skipped, and one that broke off is written anew. One commit runs at a time.
Only ledger rows of the batch's documents are looked up, and every `COMPACT` batches ledgers and deltas are
merged into one; a merged set counts once the list of its batches is complete.

Inserting what is there revises it, deleting what isn't there does nothing. Changes of one document, version, batch and
`seq` go by the greatest (op, source, lang, tokens); null is least, also as `seq`. Other ops than insert, revise and delete are
left out. Null ids, versions, sources and languages are kinds of their own; null token counts are 0. An empty batch commits an
empty delta, no batches give no totals. Texts are counted whole, in blocks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm.common import blocks, stored
from repoloom.llm.subword import Subwords

KEY = ["doc_id", "version"]
OPS = ("insert", "revise", "delete")
STATE = "doc_id long, version string, source string, lang string, tokens long, live boolean, batch long"
#: Batches that are read one by one before they are merged.
COMPACT = 8
DELTA = "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokens) by the tokenizers library, without an end id; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords.of(tokenizer)
        for b in blocks(batches, "text", 1 << 20):
            n = pa.array([len(x) for x in sub.encode(b.column("text").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), n], ["doc_id", "source", "lang", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokens long")


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number}"

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the tables of a kind that were written to the end."""
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(home)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and done(n))

    def batches(self) -> list[int]:
        """Committed batches: those whose delta is complete."""
        return self._complete("delta")

    def _merged(self) -> tuple[int | None, set[int]]:
        """Number of the last merged set, and the batches in it."""
        sets = self._complete("covers")
        if not sets:
            return None, set()
        return sets[-1], {r[0] for r in self.spark.read.parquet(self._at("covers", sets[-1])).collect()}  # a number a batch

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        merged, inside = self._merged()
        paths = [self._at(kind, b) for b in batches if b not in inside]
        paths += [self._at(f"merged_{kind}", merged)] if merged is not None else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _last(ledger: DataFrame) -> DataFrame:
        """The row of the highest batch for each document and version; a batch has one."""
        return ledger.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "live", "batch"), "batch").alias("old"))

    def compact(self) -> None:
        """Merge what is committed into one ledger and one delta."""
        before = self.batches()
        number = (self._complete("covers") or [-1])[-1] + 1
        self._last(self._read("ledger", STATE, before)).select(*KEY, "old.*").write.mode("overwrite").parquet(self._at("merged_ledger", number))
        self._sum(self._read("delta", DELTA, before)).write.mode("overwrite").parquet(self._at("merged_delta", number))
        self.spark.createDataFrame([(b,) for b in before], "batch long").write.mode("overwrite").parquet(self._at("covers", number))

    @staticmethod
    def _sum(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (seq, op insert|revise|delete, doc_id, version, source, lang, tokens); False if it was before."""
        before = self.batches()
        if batch in before:
            return False
        last = F.max(F.struct("seq", "op", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))).alias("new")
        new = stored(changes.filter(F.col("op").isin(*OPS)).groupBy(*KEY).agg(last))  # of a known size, so a small batch is broadcast
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEY]
        ledger = self._read("ledger", STATE, before).alias("o").join(new.select(*KEY).alias("n"), same, "left_semi")
        both = new.alias("n").join(self._last(ledger).alias("o"), same, "left").select("n.doc_id", "n.version", "new", "old")
        there = F.coalesce("old.live", F.lit(False))
        put = F.col("new.op").isin("insert", "revise")
        both = both.filter(F.col("old").isNull() | (F.col("old.batch") < batch))  # late changes move nothing
        state = both.select(*KEY, "new.source", "new.lang", "new.tokens", put.alias("live"), F.lit(batch).cast("long").alias("batch"), F.when(there, F.col("old")).alias("old"))
        made = self._at("ledger", batch)
        state.write.mode("overwrite").parquet(made)
        rows = self.spark.read.parquet(made)
        plus = rows.filter("live").select("source", "lang", "version", F.lit(1).alias("docs"), "tokens")
        minus = rows.filter("old is not null").select("old.source", "old.lang", "version", F.lit(-1).alias("docs"), (-F.col("old.tokens")).alias("tokens"))
        self._sum(plus.union(minus)).write.mode("overwrite").parquet(self._at("delta", batch))
        if len(before) + 1 - len(self._merged()[1]) >= COMPACT:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all commits; groups without documents are left out."""
        deltas = self._sum(self._read("delta", DELTA, self.batches()))
        return deltas.withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"}).filter("n_docs <> 0")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all texts under two vocabularies; exact copies of a text with a smaller id
    deleted; texts with runs of blanks counted anew with single ones; the deletions once more, without effect."""
    import uuid

    import public_tokenizers

    from repoloom.session import ensure_checkpoint_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = {v: public_tokenizers.path(f"{v}.json") for v in ("byte_bpe_50k", "word_bpe_49k")}
    versions = F.explode(F.array(*map(F.lit, paths))).alias("version")
    rollup = Rollup(spark, f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}")

    def changes(op: str, rows: dict[str, DataFrame]) -> DataFrame:
        parts = [df.select(F.lit(1).alias("seq"), F.lit(op).alias("op"), "doc_id", F.lit(v).alias("version"), "source", "lang", "tokens") for v, df in rows.items()]
        return parts[0].unionByName(parts[1])

    rollup.commit(0, changes("insert", {v: count_tokens(docs, p) for v, p in paths.items()}))
    key = docs.select(F.col("doc_id").cast("long"), F.sha2("text", 256).alias("digest")).filter("digest is not null")
    first = stored(key.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    copies = stored(key.join(first, "digest").filter("doc_id > first").select("doc_id").distinct())
    gone = copies.select(F.lit(1).alias("seq"), F.lit("delete").alias("op"), "doc_id", versions).select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("tokens", "long"))))
    rollup.commit(1, gone)
    blank = docs.filter(F.contains("text", F.lit("  "))).withColumn("text", F.regexp_replace("text", " {2,}", " "))
    changed = blank.join(copies.withColumnRenamed("doc_id", "_gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
    rollup.commit(2, changes("revise", {v: count_tokens(changed, p) for v, p in paths.items()}))
    rollup.commit(1, gone)
    return rollup.totals()

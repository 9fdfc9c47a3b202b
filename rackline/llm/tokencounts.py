"""Token totals by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackline.llm.storage import exists

KEYS = ("source", "lang", "version")


@dataclass(frozen=True)
class Tokenizer:
    """A byte-pair vocabulary in tiktoken's file form; ``version`` names it in the totals."""

    path: str
    pattern: str
    version: str

    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def count_tokens(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, source, lang, version, tokens) of every row of ``docs``; null texts have 0 tokens.

    Whole texts are encoded.  The driver reads the vocabulary and sends it to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer.ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding(
            tokenizer.version, pat_str=tokenizer.pattern, mergeable_ranks=shared.value, special_tokens={}
        )
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer.version).alias("version"), "tokens")


class TokenRollup:
    """Totals below one folder: a ledger of signed document counts, and their sums by batch.

    A batch is two tables, written one after the other: ``ledger/batch=<id>`` and
    ``totals/batch=<id>``.  Spark's commit marker of the second makes it count.  A batch
    that was cut off before is written anew; one that counts is never applied again.
    One writer at a time may commit a given id.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: str = "") -> str:
        return f"{self.folder}/{table}" + (f"/batch={batch}" if batch else "")

    def committed(self, batch: str) -> bool:
        return exists(self.spark, self._path("totals", batch) + "/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed ``changes`` (doc_id, source, lang, version, tokens, sign) once; False if done before.

        Null sources and languages are groups of their own; an empty batch is committed too.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")
        if self.committed(batch):
            return False
        ledger = changes.select("doc_id", *KEYS, "tokens", F.col("sign").cast("int").alias("sign"))
        ledger.write.mode("overwrite").parquet(self._path("ledger", batch))
        stored = self.spark.read.schema(ledger.schema).parquet(self._path("ledger", batch))
        sums = stored.groupBy(*KEYS).agg(
            F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        sums.write.mode("overwrite").parquet(self._path("totals", batch))
        return True

    def _committed_rows(self, table: str, schema: str, batches: list[str]) -> DataFrame:
        reader = self.spark.read.schema(schema)
        paths = [self._path(table, b) for b in batches if self.committed(b)]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, batches: list[str]) -> DataFrame:
        """Counts of the documents that the batches leave in force, n rows for a document present n times."""
        rows = self._committed_rows(
            "ledger", "doc_id long, source string, lang string, version string, tokens long, sign int", batches
        )
        left = rows.groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("n")).where("n > 0")
        return left.select("doc_id", *KEYS, "tokens", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")

    def totals(self, batches: list[str]) -> DataFrame:
        """(source, lang, version, documents, tokens) over the committed ones of ``batches``; no row for no documents."""
        rows = self._committed_rows(
            "totals", "source string, lang string, version string, documents long, tokens long", batches
        )
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(1))


def deletes(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Take back what is in force of the documents in ``ids`` (doc_id); unknown ids do nothing."""
    return current.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("sign", F.lit(-1))


def revisions(current: DataFrame, counted: DataFrame) -> DataFrame:
    """Replace what is in force of the documents in ``counted`` under the same version; new ones come in.

    ``counted`` is read twice, and so is best a stored table.
    """
    old = current.join(counted.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi")
    return old.withColumn("sign", F.lit(-1)).unionByName(inserts(counted))

"""A corpus from raw documents: five stages, each written as Parquet and read by the next.

Toxic documents go, later copies of repeated line runs are cut out, of near-duplicates
one document stays, benchmark passages are cut out, and sources are mixed to weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackline.llm import decontaminate, linededup, mixing, simhash, toxicity
from rackline.llm.storage import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edited(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    chars = F.length("text").cast("long").alias("n_chars")
    return docs.select(*(chars if c == "n_chars" else F.col(c) for c in COLUMNS))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled ones among them, doesn't call toxic."""
    network = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, network).where("predicted = 0").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those with nothing else left go."""
    cut = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return _edited(cut.where(~emptied))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, fingerprints linked at SimHash's own distance, the document with the smallest doc_id, once."""
    return simhash.keep_one(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark."""
    return _edited(decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number of copies that the mix takes, 0 included."""
    return mixing.mix(docs).select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("source_mix", mixed),
]

#: Neither the network's scores nor XXH64 fingerprints can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: every document kept, once, with ``copies``, its weight in the mix.

    A document of 0 copies is left out of the mix; one of 2 counts twice.
    """
    work = Workspace(spark, "pipeline")
    docs, before = _read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs

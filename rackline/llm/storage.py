"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rackline.sources.tables import shared_folder, written


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with the scheme that Spark itself would give it, for readers that don't know Spark's default."""
    fs, where = _file_system(spark, path)
    return where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toASCIIString()


class Workspace:
    """Tables that one run of an operator writes and reads again.

    ``save`` cuts the lineage: a lost executor costs the tasks that it ran, not the
    table.  ``drop`` frees a table that a later one has replaced.  What the returned
    DataFrame still reads stays below the application's folder, for the cluster to
    expire with the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        application = spark.sparkContext.applicationId
        self.folder = f"{shared_folder(spark)}/{application}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        for observer in written:
            observer(df)
        df.write.mode("overwrite").parquet(self.path(name))
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


class Shared:
    """A value sent to all executors once, along with the code of its class."""

    def __init__(self, spark: SparkSession, value):
        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self._data.value)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)

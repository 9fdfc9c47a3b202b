"""Table catalog, loader, parquet sink and materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Tables:
    """The four logical tables of a dataset, bound to one base path."""

    base: str
    # File names of the published tables.
    jobs: str = "slurm_table_cleaned.parquet"
    node_samples: str = "prom_table_cleaned.parquet"
    job_samples: str = "prom_slurm_joined.parquet"
    node_hardware: str = "node_hardware_info.parquet"

    NAMES = ("jobs", "node_samples", "job_samples", "node_hardware")

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{getattr(self, name)}"

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return load(spark, self.path(name))

    def register(self, spark: SparkSession, names=NAMES) -> None:
        """Expose the tables to ``spark.sql`` under their logical names."""
        for name in names:
            self.load(spark, name).createOrReplaceTempView(name)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literal_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A small in-memory table; the schema is explicit so nulls are allowed."""
    return spark.createDataFrame(rows, schema)


_own_folders: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)
#: Names of bucketed tables by the scope that they go with.
_bucketed: dict[str | None, list[str]] = {}
#: Called with every DataFrame that is about to be written by :func:`materialise`.
written: list[Callable[[DataFrame], None]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder, which goes when the
    process ends: driver and executors are one process there.  Any other master
    must name one.  The session is left as it is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _own_folders:
        folder = tempfile.mkdtemp(prefix="rackline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folders[context.applicationId] = folder
    return _own_folders[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[str]:
    """Own the tables that :func:`materialise` writes inside, and delete them at the end.

    What was built inside must have been used by then: written, collected or counted.
    """
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        for name in _bucketed.pop(folder, ()):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, where = _file_system(spark, folder)
        fs.delete(where, True)


def fresh_path(spark: SparkSession) -> str:
    """A new place for a table, in the folder of the surrounding :func:`intermediate_tables`,
    or else below a name made of the application id; it goes with the scope or the application."""
    folder = _scope.get()
    if folder is None:
        folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
        fs, where = _file_system(spark, folder)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{folder}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as parquet and read it back, which cuts its lineage.

    Without a path the table goes to a :func:`fresh_path`.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark)
    for observer in written:
        observer(df)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def store_bucketed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Write ``df`` in buckets by ``keys``, sorted by them, and read it back as a table.

    One shuffle places the rows; later joins and groups by all of the keys need none.  There
    are as many buckets as shuffle partitions (200 where that is not a number).  Take keys
    of which none holds much of the table, as a bucket is read by one task.
    """
    spark = df.sparkSession
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    buckets = int(setting) if setting.isdigit() else 200
    name = f"bucketed_{uuid.uuid4().hex}"
    for observer in written:
        observer(df)
    (
        df.repartition(buckets, *keys)
        .write.option("path", fresh_path(spark))
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
    _bucketed.setdefault(_scope.get(), []).append(name)
    return spark.table(name)


#: Parquet settings for a joined table in order of node and time.  From one instant to the
#: next the same jobs run, so their columns repeat, byte for byte where they are plain, over
#: some distance: pages hold many instants, and the compressor looks back over them.
REPEATING = {
    "compression": "zstd",
    # Lower levels miss most repeats of columns with few different bytes, such as whole minutes.
    "parquet.compression.codec.zstd.level": "9",
    "parquet.enable.dictionary": "false",
    "parquet.page.size": str(4 << 20),
    "parquet.page.row.count.limit": str(1 << 20),
}


def write_joined(
    df: DataFrame, path: str, order=("node", "timestamp", "start_date"), in_order: bool = False
) -> None:
    """Overwrite ``path`` with the joined table, clustered by node and time.

    Range partitioning on all order columns spreads a busy node over many files,
    and the narrow min/max of each row group serves later node or time filters.

    That moves every row, and rows are as many as pairs of samples and jobs.  A table that
    is made ``in_order`` (``integrate(..., in_order=True)``) is written as it comes, without
    a shuffle or a sort: a file then has whole blocks of a node and a few hours, each in order.
    """
    rows = df if in_order else df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").options(**(REPEATING if in_order else {})).parquet(path)


def columns_of_type(df: DataFrame, data_type: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, data_type)]


def columns_with(df: DataFrame, *parts: str) -> list[str]:
    """Names that contain every one of the given parts."""
    return [c for c in df.columns if all(p in c for p in parts)]


def select_by_dtype(df: DataFrame, data_type: type[T.DataType]) -> DataFrame:
    return df.select(*columns_of_type(df, data_type))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

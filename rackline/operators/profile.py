"""Table profiles: null shares, column overviews, complete rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackline.functions.stats import count_where


def _pct_null(c: str) -> Column:
    return 100.0 * count_where(F.col(c).isNull()) / F.count(F.lit(1))


def null_pct(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, one wide row; NaN is a value here."""
    return df.agg(*[_pct_null(c).alias(c) for c in df.columns])


def null_pct_by(df: DataFrame, by: str = "node") -> DataFrame:
    """Null percentages per group (``c%null``) and their mean (``cols_mean%null``).

    The key's own percentage takes part in the mean.
    """
    per_group = df.groupBy(by).agg(*[_pct_null(c).alias(f"{c}%null") for c in df.columns])
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}%null`") for c in df.columns])
    return per_group.withColumn("cols_mean%null", F.round(total / len(df.columns), 3))


def _profile_aggregates(df: DataFrame) -> list[Column]:
    nothing = F.lit(None).cast("double")
    aggregates = []
    for i, field in enumerate(df.schema.fields):
        c, is_double = F.col(f"`{field.name}`"), isinstance(field.dataType, T.DoubleType)
        aggregates += [
            _pct_null(f"`{field.name}`").alias(f"null_{i}"),
            F.min(c).cast("string").alias(f"example_{i}"),
            (F.round(F.avg(c), 2) if is_double else F.max(nothing)).alias(f"mean_{i}"),
            (F.round(F.stddev_samp(c), 2) if is_double else F.max(nothing)).alias(f"std_{i}"),
        ]
    return aggregates


def _profile_rows(row: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One row per column, from the one row of all aggregates."""
    entries = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("dataType"),
            F.col(f"null_{i}").alias("null_percentage"),
            F.col(f"example_{i}").alias("example_value"),
            F.col(f"mean_{i}").alias("mean"),
            F.col(f"std_{i}").alias("std"),
        )
        for i, f in enumerate(fields)
    ]
    long = row.select(F.inline(F.array(*entries)))
    variation = F.when(
        F.col("mean") > 0, F.round(F.try_divide(F.col("std"), F.col("mean")), 4)
    )
    return long.withColumn("coeff_var", variation)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, null share, an example, mean, deviation and
    coefficient of variation (doubles only; the latter from rounded numbers).

    All of it is a single aggregate over the table, reshaped afterwards.  The
    example is the smallest value, which does not depend on the row order.
    """
    return _profile_rows(df.agg(*_profile_aggregates(df)), df.schema.fields)


class Profiled:
    """The profile of a table, measured while something that reads all of it runs.

    Use ``table`` in place of the table; once that has been written or counted,
    ``profile()`` is there without another pass.
    """

    def __init__(self, df: DataFrame):
        self._source = df
        self._seen = Observation(f"profile-{uuid.uuid4().hex}")
        self.table = df.observe(self._seen, *_profile_aggregates(df))

    def profile(self) -> DataFrame:
        kinds = self._source.agg(*_profile_aggregates(self._source)).schema
        values = self._seen.get
        row = self._source.sparkSession.createDataFrame([tuple(values[f.name] for f in kinds.fields)], kinds)
        return _profile_rows(row, self._source.schema.fields)


def overview(df: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """Row count, column count and time range of a table."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.min(first).alias("first_time"),
        F.max(last).alias("last_time"),
    )


def null_mask(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Is-null flag of every column, beside the kept ones."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, *[F.col(c).isNull().alias(c) for c in rest])


def null_mask_by_hour(df: DataFrame, node: str = "node", ts: str = "timestamp") -> DataFrame:
    """Null counts per node and hour: the mask at a resolution that can be looked at."""
    hour = F.date_format(F.col(ts), "yyyy-MM-dd HH").alias("hour")
    rest = [c for c in df.columns if c not in (node, ts)]
    return df.groupBy(node, hour).agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_where(F.col(c).isNull()).alias(f"null_{c}") for c in rest],
    )


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows in total and rows without any null."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), count_where(whole).alias("complete_rows"))

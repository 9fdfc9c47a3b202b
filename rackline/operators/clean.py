"""Filling and dropping missing values."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackline.sources.tables import columns_of_type, materialise

EMPTY_MAP = "{}"


def _fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wanted = df.select(*dict.fromkeys(cols))
    texts = columns_of_type(wanted, T.StringType)
    numbers = columns_of_type(wanted, T.DoubleType)
    fillers = {**dict.fromkeys(texts, EMPTY_MAP), **dict.fromkeys(numbers, 0.0)}
    return df.fillna(fillers) if fillers else df


def fill_drop(
    df: DataFrame, name_contains: str = "nvidia", also: Sequence[str] = ()
) -> DataFrame:
    """Fill the matching columns (text with an empty map, doubles with 0), then
    drop every row that still has a null.  ``also`` names further columns to fill,
    for tables with many late-added metrics."""
    matching = [c for c in df.columns if name_contains in c]
    return _fill(df, [*matching, *also]).dropna()


def fill_drop_all(df: DataFrame) -> DataFrame:
    """As :func:`fill_drop`, with all columns filled by type."""
    return _fill(df, df.columns).dropna()


def dropped_pct(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of rows lost between two states of a table, in percent."""
    counted = before.agg(
        F.count(F.lit(1)).alias("rows_before"), F.lit(0).cast("bigint").alias("rows_after")
    ).unionByName(
        after.agg(
            F.lit(0).cast("bigint").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
        )
    )
    totals = counted.agg(
        F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after")
    )
    return _with_share(totals)


def _with_share(totals: DataFrame) -> DataFrame:
    lost = F.try_divide(
        100.0 * (F.col("rows_before") - F.col("rows_after")), F.col("rows_before")
    )
    return totals.withColumn("dropped_pct", F.round(lost, 2))


def drop_observed(before: DataFrame, clean: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``clean(before)`` as a stored table, and what :func:`dropped_pct` says of it.

    Rows are counted before and after in the pass that writes the table.
    """
    rows, left = Observation(f"before-{uuid.uuid4().hex}"), Observation(f"after-{uuid.uuid4().hex}")
    count = F.count(F.lit(1)).alias("rows")
    after = materialise(clean(before.observe(rows, count)).observe(left, count))
    counts = [(rows.get["rows"], left.get["rows"])]
    totals = before.sparkSession.createDataFrame(counts, "rows_before long, rows_after long")
    return after, _with_share(totals)

"""Reading a table together with its profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rackline.operators.clean import fill_drop
from rackline.operators.ordered import every_nth
from rackline.operators.profile import Profiled
from rackline.sources.tables import load, materialise


def read_table(
    spark: SparkSession,
    path: str,
    nth: int = 1,
    sort: bool = False,
    clean: bool = False,
    order=("node", "timestamp"),
) -> tuple[DataFrame, DataFrame]:
    """Load a table, optionally keep every n-th row, sort and clean it.

    Returns the table, which is written out, and the profile of what was read (before
    cleaning), which is measured in the pass that writes it.  A sorted table is sorted when
    it is used.
    """
    df = load(spark, path)
    if nth > 1:
        df = every_nth(df, nth, order)
    seen = Profiled(df)
    table = materialise(fill_drop(seen.table) if clean else seen.table)
    return (table.orderBy(*order) if sort else table), seen.profile()

"""Small statistical expressions that stay defined under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def count_where(predicate: Column) -> Column:
    return F.count(F.when(predicate, F.lit(1)))

"""Joining a large table with a table that is usually, but not surely, small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from rackline.sources.tables import materialise


def same_keys(left: DataFrame, left_keys, right: DataFrame, right_keys):
    """Null-safe equality of key columns, for joining a group's result back."""
    pairs = zip(left_keys, right_keys, strict=True)
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def attach(fact: DataFrame, dimension: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``dimension`` to ``fact`` on equal, non-null keys.

    A plain equi-join: the planner broadcasts the dimension if its bytes are below
    ``spark.sql.autoBroadcastJoinThreshold``, by estimate or as measured while running,
    and splits skewed partitions otherwise.
    """
    return fact.join(dimension, [on] if isinstance(on, str) else list(on), how)


def attach_group(fact: DataFrame, groups: DataFrame, by) -> DataFrame:
    """Join per-group results (one row per ``by``) back to their rows.

    The results are written out first.  That evaluates the aggregate once, and
    gives the planner their true size: it broadcasts them only if they are below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise runs an equi-join
    whose skewed partitions it splits.  A null key is a group of its own.
    """
    return join_group(fact, materialise(groups), by)


def join_group(fact: DataFrame, stored: DataFrame, by) -> DataFrame:
    """As :func:`attach_group`, for results that are a stored table already."""
    keys = list(by)
    hidden = [f"__{k}" for k in keys]
    right = stored.withColumnsRenamed(dict(zip(keys, hidden, strict=True)))
    return fact.join(right, same_keys(fact, keys, right, hidden), "left").drop(*hidden)

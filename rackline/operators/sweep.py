"""Points and intervals on a line, without pairing them.

Points and the two ends of every interval are put in one order.  A running sum of +1
at starts and -1 after ends is the number of intervals that hold a point; the
difference of a running sum over the points, between an interval's two ends, is the
sum over the points inside.  Both cost one row for each point and two for each
interval, however many points an interval holds.

A key's line is cut into buckets of time, which are swept apart from each other; what
they miss is the total of the buckets before, one row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackline.functions.times import epoch_seconds
from rackline.operators.joins import BUCKET_SECONDS, spread
from rackline.sources.tables import materialise

#: Order at one instant: starts, points, ends.  Intervals are closed.
START, POINT, END = 0, 1, 2


def _before(totals: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """For each key and each of its buckets the sum of ``columns`` over the key's earlier buckets.

    Buckets after one that has totals get rows too, up to the next that has some; what
    comes after the last gets none.
    """
    order = Window.partitionBy(by).orderBy("_bucket")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead("_bucket").over(order), F.col("_bucket") + 1)
    summed = totals.select(
        F.col(by).alias("_key"),
        F.col("_bucket").alias("_from"),
        following.alias("_to"),
        *[F.sum(c).over(upto).alias(f"_before_{c}") for c in columns],
    )
    return summed.select(
        "_key",
        F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_at_bucket"),
        *[f"_before_{c}" for c in columns],
    )


def _join_before(rows: DataFrame, before: DataFrame, by: str, columns: list[str]) -> DataFrame:
    same = (F.col(by) == F.col("_key")) & (F.col("_bucket") == F.col("_at_bucket"))
    joined = rows.join(before, same, "left").drop("_key", "_at_bucket")
    return joined.withColumns({f"_before_{c}": F.coalesce(f"_before_{c}", F.lit(0)) for c in columns})


def merged(intervals: DataFrame, *, by: Sequence[str], start: str, end: str) -> DataFrame:
    """``by..., start, end`` of the union of the intervals of each ``by``: those that meet are one.

    Null keys are a key of their own; intervals that end before they start are left out.
    """
    order = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    some = intervals.where(F.col(start) <= F.col(end)).select(*by, start, end)
    opened = some.withColumn("_opens", F.when(F.col(start) <= reached, 0).otherwise(1))
    growing = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = opened.withColumn("_island", F.sum("_opens").over(growing)).groupBy(*by, "_island")
    return islands.agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def held_at(
    points: DataFrame,
    intervals: DataFrame,
    *,
    by: str,
    at: str,
    start: str,
    end: str,
    counts: Sequence[str],
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """``points`` with the sum of every column of ``counts`` over the intervals that hold the point.

    ``points`` has at most one row for each key and instant: aggregate it before.  Intervals
    are closed; those that end before they start, and null keys and times, are left out.
    A point costs one row and an interval two, which are combined where they meet at one instant.
    """
    bucket = F.floor(epoch_seconds(F.col("_at")) / F.lit(bucket_seconds)).alias("_bucket")
    sides = F.array(
        F.struct(F.col(start).alias("_at"), F.lit(START).alias("_kind"), F.lit(1).alias("_sign")),
        F.struct(F.col(end).alias("_at"), F.lit(END).alias("_kind"), F.lit(-1).alias("_sign")),
    )
    some = intervals.where(F.col(by).isNotNull() & (F.col(start) <= F.col(end)))
    ends = some.select(by, *counts, F.inline(sides))
    # Written out, as it is used twice.
    marks = materialise(ends.groupBy(by, "_at", "_kind").agg(*[F.sum(F.col("_sign") * F.col(c)).alias(f"_step_{c}") for c in counts]))
    steps = marks.select("*", bucket).groupBy(by, "_bucket").agg(*[F.sum(f"_step_{c}").alias(c) for c in counts])
    there = points.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    rows = there.withColumnRenamed(at, "_at").withColumn("_kind", F.lit(POINT)).unionByName(marks, allowMissingColumns=True)

    growing = Window.partitionBy(by, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = spread(rows.select("*", bucket), by, "_bucket")
    swept = _join_before(swept, _before(steps, by, list(counts)), by, list(counts))
    kept = [F.col("_at").alias(at) if c == at else F.col(c) for c in points.columns]
    sums = [(F.coalesce(F.sum(f"_step_{c}").over(growing), F.lit(0)) + F.col(f"_before_{c}")).alias(c) for c in counts]
    return swept.select(*kept, *sums, "_kind").where(F.col("_kind") == POINT).drop("_kind")


def sums_inside(
    points: DataFrame,
    intervals: DataFrame,
    *,
    by: str,
    at: str,
    start: str,
    end: str,
    held: str,
    values: dict[str, Column],
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Two rows for each interval, with sums over points, whose values add up to those inside it.

    ``points`` has at most one row for each key and instant: aggregate it before.  ``values``
    are columns made of those of the points and of ``held``, the number of intervals that hold
    the point.  An interval's start has what came before it with a minus sign, its end what
    came up to it; group the result by the interval and add.  Intervals that end before they
    start, and null keys and times, are left out.  Sums of doubles carry the rounding of a
    running sum over the whole key.

    Ends of intervals that meet on a key at one instant are one row of the sweep, so what a
    task has to order is bounded by the distinct instants of a bucket; a busy key is spread
    over its buckets.  Intervals get their sums by a join, of which Spark splits busy keys.
    """
    bucket = F.floor(epoch_seconds(F.col("_at")) / F.lit(bucket_seconds)).alias("_bucket")
    sides = F.array(
        F.struct(F.col(start).alias("_at"), F.lit(START).alias("_kind"), F.lit(1).alias("_step")),
        F.struct(F.col(end).alias("_at"), F.lit(END).alias("_kind"), F.lit(-1).alias("_step")),
    )
    # Written out, as it is used three times.
    some = materialise(intervals.where(F.col(by).isNotNull() & (F.col(start) <= F.col(end))))
    ends = some.select("*", F.inline(sides))
    marks = ends.groupBy(by, "_at", "_kind").agg(F.sum("_step").alias("_step"))
    steps = ends.select(by, bucket, "_step").groupBy(by, "_bucket").agg(F.sum("_step").alias("steps"))
    there = points.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    rows = there.withColumnRenamed(at, "_at").withColumn("_kind", F.lit(POINT)).unionByName(marks, allowMissingColumns=True)

    own = Window.partitionBy(by, "_bucket").orderBy("_at", "_kind")
    growing = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = spread(rows.select("*", bucket), by, "_bucket")
    swept = _join_before(swept, _before(steps, by, ["steps"]), by, ["steps"])
    swept = swept.withColumn(held, F.coalesce(F.sum("_step").over(growing), F.lit(0)) + F.col("_before_steps"))
    amounts = {f"_sum_{c}": v for c, v in values.items()}
    swept = swept.select(
        by,
        "_bucket",
        "_at",
        "_kind",
        F.lead("_kind").over(own).isNull().alias("_last"),
        *[F.coalesce(F.sum(F.when(F.col("_kind") == POINT, v)).over(growing), F.lit(0)).alias(c) for c, v in amounts.items()],
    )
    # Only marks, and the last row of each bucket, which has its totals.
    swept = materialise(swept.where((F.col("_kind") != POINT) | F.col("_last")))
    before = _before(swept.where("_last"), by, list(amounts))
    marked = _join_before(swept.where(F.col("_kind") != POINT), before, by, list(amounts))
    sign = F.when(F.col("_kind") == START, -1).otherwise(1)
    sums = marked.select(
        by, "_at", "_kind", *[(sign * (F.col(c) + F.col(f"_before_{c}"))).alias(c.removeprefix("_sum_")) for c in amounts]
    )
    return ends.join(sums, [by, "_at", "_kind"]).drop("_at", "_kind", "_step")

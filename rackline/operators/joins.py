"""Interval join of timestamped points with intervals on several keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackline.functions.times import epoch_seconds

# Six hours: a job of median length stays in one bucket, and one node's samples
# at a 30 s rate are 720 rows per bucket.
BUCKET_SECONDS = 6 * 3600
#: Each level's buckets are so many times as wide as those of the level below.
FACTOR = 16
#: At six hours and 16, the widest buckets are longer than a century.
LEVELS = 5
#: So many intervals, and so many points, at most become one row where pairs are listed.
PACK, RUN = 1024, 8


def top_level(first: Column, last: Column) -> Column:
    """The widest level that an interval of buckets first..last can use, or one above."""
    level = F.floor(F.log2(last - first + 1) / F.lit(math.log2(FACTOR)) + F.lit(1e-9))
    return F.least(level, F.lit(LEVELS - 1)).cast("int")


def _width(level: Column) -> Column:
    """Base buckets in a bucket of the level; FACTOR is a power of two."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level * F.lit(FACTOR.bit_length() - 1))


def _named(level: Column, bucket: Column) -> Column:
    """One number for a bucket of a level; buckets are far fewer than 2^39."""
    return bucket + level.cast("long") * F.lit(1 << 40)


def cover(first: Column, last: Column) -> Column:
    """The interval of base buckets first..last as an array of named buckets that tile it.

    Aligned runs of buckets are one bucket of the next level, and so on: a long interval
    takes up to 2 * (FACTOR - 1) buckets of each level, not one for each base bucket.
    """

    def blocks(level: Column, low: Column, high: Column) -> Column:
        made = F.sequence(_named(level, low), _named(level, high))
        return F.when(low <= high, made).otherwise(F.array().cast("array<bigint>"))

    def tiles(level: Column) -> Column:
        """What of the interval is left to buckets of this level: its ends, outside the next level's."""
        width, wide = _width(level), _width(level + 1)
        low, high = F.ceil(first / width), F.floor((last + 1) / width) - 1
        inner_low, inner_high = F.ceil(first / wide) * FACTOR, F.floor((last + 1) / wide) * FACTOR - 1
        split = (level < LEVELS - 1) & (inner_low <= inner_high)
        return F.concat(
            blocks(level, low, F.when(split, inner_low - 1).otherwise(high)),
            F.when(split, blocks(level, inner_high + 1, high)).otherwise(F.array().cast("array<bigint>")),
        )

    # Usually no aligned run of FACTOR buckets fits, and a plain sequence will do.
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    return F.when(last - first + 1 < FACTOR, F.sequence(first, last)).otherwise(F.flatten(F.transform(levels, tiles)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions by key, for small rows on which much work follows.

    A stated number of partitions is kept as it is; without one, they would be merged by
    their small present size.
    """
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(setting), *keys) if setting.isdigit() else df.repartition(*keys)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    *,
    key: str = "node",
    ts: str = "timestamp",
    keys: str = "slurm_nodes",
    start: str = "start_date",
    end: str = "end_date",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Pairs with ``point.key`` in ``interval.keys`` and ``start <= ts <= end``.

    Both predicates of the theta join become equi-join keys: intervals are exploded to
    one row per distinct key and bucket of their :func:`cover`, points to one row per
    level that intervals of their key use, and the closed range check runs on the
    matches only.  A point lies in one bucket of an interval's cover, so every pair
    appears once.  Keys with short intervals only use one level, so their points are not
    multiplied; points of keys without intervals are left out before the shuffle.

    A busy key is spread over its time buckets.  If one (key, bucket) is still
    much larger than the rest, the adaptive planner splits that partition of the
    points and joins each piece with the matching intervals.  Neither side
    carries a broadcast hint: Spark broadcasts only below its size threshold.
    """
    bucketed, exploded = _bucketed(points, intervals, key, ts, keys, start, end, bucket_seconds)
    return bucketed.join(
        exploded,
        (F.col(key) == F.col("_key"))
        & (F.col("_point_bucket") == F.col("_bucket"))
        & F.col(ts).between(F.col(start), F.col(end)),
    ).drop("_key", "_bucket", "_point_bucket", "_base", "_first", "_last")


def _bucketed(
    points: DataFrame, intervals: DataFrame, key: str, ts: str, keys: str, start: str, end: str, bucket_seconds: int
) -> tuple[DataFrame, DataFrame]:
    """Points with ``_point_bucket``, once for each level in use, and their base bucket
    ``_base``; intervals with ``_key`` and ``_bucket``, once for each key and bucket of their cover."""
    width = F.lit(bucket_seconds)
    first, last = F.col("_first"), F.col("_last")
    some = intervals.where(F.col(start) <= F.col(end)).withColumns(
        {"_first": F.floor(epoch_seconds(F.col(start)) / width), "_last": F.floor(epoch_seconds(F.col(end)) / width)}
    )
    exploded = some.select("*", F.explode(F.array_distinct(F.col(keys))).alias("_key")).select(
        "*", F.explode(cover(first, last)).alias("_bucket")
    )
    levels = (
        some.where(last - first + 1 >= FACTOR)
        .select(top_level(first, last).alias("_top"), F.explode(F.array_distinct(F.col(keys))).alias("_of"))
        .groupBy("_of")
        .agg(F.max("_top").alias("_top"))
    )
    at = F.floor(epoch_seconds(F.col(ts)) / width)

    leveled = points.withColumn("_at", at).join(levels, F.col(key) == F.col("_of"), "left")
    of_key = F.sequence(F.lit(0), F.coalesce(F.col("_top"), F.lit(0)))
    place = _named(F.col("_level"), F.floor(F.col("_at") / _width(F.col("_level"))))
    bucketed = leveled.select(*points.columns, "_at", F.explode(of_key).alias("_level"))
    return bucketed.select(*points.columns, place.alias("_point_bucket"), F.col("_at").alias("_base")), exploded


def _packed(exploded: DataFrame, start: str, end: str, own: Sequence[str], in_order: bool = False) -> DataFrame:
    """Intervals of a key and bucket, in order of start, as rows of up to :data:`PACK`, with the time that they span."""
    place = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(start)) - 1
    numbered = spread(exploded.select("_key", "_bucket", start, end, *own), "_key", "_bucket").withColumn("_pack", F.floor(place / PACK))
    packed = F.collect_list(F.struct(start, end, *own))
    return numbered.groupBy("_key", "_bucket", "_pack").agg(
        F.min(start).alias("_from"), F.max(end).alias("_to"), (F.sort_array(packed) if in_order else packed).alias("_intervals")
    )


def interval_join_listed(
    points: DataFrame,
    intervals: DataFrame,
    columns: Sequence[str],
    *,
    key: str = "node",
    ts: str = "timestamp",
    keys: str = "slurm_nodes",
    start: str = "start_date",
    end: str = "end_date",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """``columns`` of the pairs of :func:`interval_join`, for many pairs of which all are listed.

    Intervals of a (key, bucket) lie together in rows of up to :data:`PACK`, so a point meets
    a row for each pack, and not one for each interval that its range check may drop; a pack
    that the point lies outside of is not opened.  What a task holds at once are the packs of
    one bucket and the pairs of one point.  The pairs of a bucket are made by one task: take
    narrower buckets, or :func:`interval_join`, where a key has very many rows in a bucket.
    """
    own = [c for c in intervals.columns if c in columns and c not in (start, end)]
    bucketed, exploded = _bucketed(points, intervals, key, ts, keys, start, end, bucket_seconds)
    packs = _packed(exploded, start, end, own)
    same = (F.col(key) == F.col("_key")) & (F.col("_point_bucket") == F.col("_bucket"))
    met = bucketed.join(packs.hint("merge"), same & F.col(ts).between(F.col("_from"), F.col("_to")))
    kept = [c for c in points.columns if c in columns or c == ts]
    return met.select(*kept, F.inline("_intervals")).where(F.col(ts).between(F.col(start), F.col(end))).select(*columns)


def interval_join_in_order(
    points: DataFrame,
    intervals: DataFrame,
    columns: Sequence[str],
    *,
    key: str = "node",
    ts: str = "timestamp",
    keys: str = "slurm_nodes",
    start: str = "start_date",
    end: str = "end_date",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """``columns`` of the pairs of :func:`interval_join`, clustered by key and time as they are made.

    For tables that are to be written so: pairs are neither shuffled nor sorted, which
    would move the product of the two sides.  Up to :data:`RUN` points that follow each other
    on a key become one row, and intervals as in :func:`interval_join_listed`; a merge join
    keeps the order of the runs, which are unfolded one by one.  Of a run, the pairs of one
    pack of intervals come in order of time and start.  What a task holds at once are the packs
    of one bucket and the pairs of one run.  The pairs of a bucket are made by one task, so take
    narrower buckets where a key has very many rows in a bucket.  Columns of intervals must be
    of types that have an order.
    """
    bucketed, exploded = _bucketed(points, intervals, key, ts, keys, start, end, bucket_seconds)
    rest = [c for c in points.columns if c in columns and c not in (key, ts)]
    own = [c for c in intervals.columns if c in columns and c not in (start, end)]
    packs = _packed(exploded, start, end, own, in_order=True)
    # A window, unlike an aggregate, leaves its rows in order.
    line = Window.partitionBy(key, "_point_bucket").orderBy(ts)
    runs = (
        spread(bucketed.select(key, "_point_bucket", ts, *rest), key, "_point_bucket")
        .withColumns({
            "_place": F.row_number().over(line) - 1,
            "_points": F.collect_list(F.struct(ts, *rest)).over(line.rowsBetween(0, RUN - 1)),
        })
        .where(F.col("_place") % RUN == 0)
    )
    met = runs.join(packs.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_point_bucket") == F.col("_bucket")))
    inside = F.col(ts).between(F.col(start), F.col(end))
    unfolded = met.select(key, "_intervals", F.inline("_points"))
    return unfolded.select(key, ts, *rest, F.inline("_intervals")).where(inside).select(*columns)

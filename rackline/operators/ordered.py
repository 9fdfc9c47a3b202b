"""Order-dependent operators that do not put a whole series into one task.

A window over ``partitionBy(series).orderBy(time)`` gathers a series in one
task, however long it is.  Here the rows are range-partitioned by
``(series, order)`` instead, so a long series spans many *segments*.  Windows
run per (series, segment); what they miss across a segment border is carried
over from a per-segment summary.  Only the first and the last series of a
segment can continue across its borders, so the carried table has at most two
rows per segment: its size is bound by the number of partitions and it can
always be broadcast.

The order must be total (end it with a unique column) for a deterministic result.
For wide tables name the columns that identify a row as ``key``: then only these
and the columns worked on are sorted and written, and the rest is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackline.functions.stats import null_if_nan
from rackline.operators.attach import same_keys
from rackline.sources.tables import materialise

SEGMENT = "_segment"
Aggregate = Callable[..., Column]


def segmented(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by ``(by, order)`` and stamp each row with its partition.

    The stamped table is written out: range borders come from sampling, and a
    recomputation must not draw them again.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, *order]])
    return materialise(ranged.withColumn(SEGMENT, F.spark_partition_id()))


def _narrow(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Only the columns an ordered operator works on, if rows have a ``key`` by
    which the others can be joined back."""
    return df.select(*dict.fromkeys([*key, *cols])) if key else df


def _widen(df: DataFrame, result: DataFrame, key: Sequence[str], added: Sequence[str]):
    """Give narrow results the other columns of their rows back."""
    if not key:
        return result
    kept = [c for c in df.columns if c not in added]
    return df.select(*kept).join(result.select(*key, *added), list(key))


def _within(by, order) -> Window:
    return Window.partitionBy(*by, SEGMENT).orderBy(*order)


def _across(by) -> Window:
    return Window.partitionBy(*by).orderBy(SEGMENT)


def _join_border(rows: DataFrame, border: DataFrame, by) -> DataFrame:
    """Attach a border table of at most two rows per segment."""
    keys = [*by, SEGMENT]
    hidden = [f"__{k}" for k in keys]
    right = F.broadcast(border.withColumnsRenamed(dict(zip(keys, hidden, strict=True))))
    return rows.join(right, same_keys(rows, keys, right, hidden), "left").drop(*hidden)


def _earlier_total(summary: DataFrame, by, amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over earlier segments of a series, where there are any."""
    before = F.sum(amount).over(_across(by).rowsBetween(Window.unboundedPreceding, -1))
    return summary.select(*by, SEGMENT, before.alias(out)).where(F.col(out).isNotNull())


def running_total(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    amount: str,
    out: str,
    totals: dict[str, tuple[Aggregate, Column]] | None = None,
) -> DataFrame:
    """Inclusive running sum of ``amount`` per series over :func:`segmented` rows.

    ``totals`` adds whole-series sums, minima or maxima as further columns, such
    as ``{"total": (F.sum, F.col("n"))}``.  A series inside one segment gets
    them from its segment's window; one that spans several from the border.
    """
    totals = totals or {}
    summary = rows.groupBy(*by, SEGMENT).agg(
        F.sum(amount).alias("_sum"), *[fn(c).alias(f"_{t}") for t, (fn, c) in totals.items()]
    )
    series = Window.partitionBy(*by)
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    border = summary.select(
        *by,
        SEGMENT,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        *[fn(f"_{t}").over(series).alias(f"_series_{t}") for t, (fn, _) in totals.items()],
        F.count(F.lit(1)).over(series).alias("_segments"),
    ).where("_segments > 1")

    growing = _within(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segment = Window.partitionBy(*by, SEGMENT)
    local = rows.select(
        "*",
        F.sum(amount).over(growing).alias("_local"),
        *[fn(c).over(segment).alias(f"_local_{t}") for t, (fn, c) in totals.items()],
    )
    return _join_border(local, border, by).select(
        *[c for c in rows.columns if c != SEGMENT],
        (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(out),
        *[F.coalesce(f"_series_{t}", f"_local_{t}").alias(t) for t in totals],
    )


def row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str = "row_index",
    key: Sequence[str] = (),
) -> DataFrame:
    """Zero-based position of each row within its series."""
    rows = segmented(_narrow(df, key, [*by, *order]), by, order)
    summary = rows.groupBy(*by, SEGMENT).agg(F.count(F.lit(1)).alias("_rows"))
    border = _earlier_total(summary, by, "_rows", "_before")
    local = rows.withColumn("_local", F.row_number().over(_within(by, order)) - F.lit(1))
    position = F.col("_local") + F.coalesce("_before", F.lit(0))
    placed = _join_border(local, border, by).withColumn(out, position.cast("bigint"))
    return _widen(df, placed, key, [out]).select(*df.columns, out)


def every_nth(
    df: DataFrame,
    n: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    key: Sequence[str] = (),
) -> DataFrame:
    """Systematic sample: rows whose zero-based position is a multiple of ``n``."""
    placed = row_index(_narrow(df, key, [*by, *order]), by, order, "_index")
    chosen = placed.where(F.col("_index") % n == 0)
    return _widen(df, chosen, key, []).select(*df.columns)


def null_rows_with_neighbours(
    df: DataFrame,
    by: Sequence[str] = ("node",),
    order: Sequence[str] = ("timestamp",),
    cols: Sequence[str] | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Rows with a null in any of ``cols`` plus the row right before and right
    after each of them in the series; adds ``has_null``."""
    has_null = F.lit(False)
    for c in cols or df.columns:
        has_null = has_null | F.col(c).isNull()
    flagged = _narrow(df.withColumn("has_null", has_null), key, [*by, *order, "has_null"])
    rows = segmented(flagged, by, order)

    window = _within(by, order)
    local = rows.select(
        "*",
        F.row_number().over(window).alias("_local"),
        F.lag("has_null").over(window).alias("_lag"),
        F.lead("has_null").over(window).alias("_lead"),
    )
    edges = local.groupBy(*by, SEGMENT).agg(
        F.min_by("has_null", "_local").alias("_first"),
        F.max_by("has_null", "_local").alias("_last"),
    )
    border = edges.select(
        *by,
        SEGMENT,
        F.lag("_last").over(_across(by)).alias("_from_before"),
        F.lead("_first").over(_across(by)).alias("_from_after"),
    ).where(F.col("_from_before").isNotNull() | F.col("_from_after").isNotNull())

    near = F.coalesce("_lag", "_from_before", F.lit(False)) | F.coalesce(
        "_lead", "_from_after", F.lit(False)
    )
    found = _join_border(local, border, by).where(F.col("has_null") | near)
    return _widen(df, found, key, ["has_null"]).select(*df.columns, "has_null")


def interpolate(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("node",),
    order: Sequence[str] = ("timestamp",),
    defaults: dict[str, float] | None = None,
    epsilon: float = 0.0,
    key: Sequence[str] = (),
) -> DataFrame:
    """Fill missing values (null or NaN) linearly by row position in the series.

    A gap at the start takes the next value, one at the end the previous value,
    a series without values the column's default (``defaults[col]``, else
    ``defaults['default']``, else 0).  ``epsilon`` is added to every filled value.
    Adds ``node_index``, the zero-based row position.
    """
    defaults = defaults or {}
    gappy = _narrow(df, key, [*by, *order, *cols])
    rows = segmented(gappy.withColumns({c: null_if_nan(F.col(c)) for c in cols}), by, order)
    local = rows.withColumn("_local", F.row_number().over(_within(by, order)) - F.lit(1))

    def known(c: str, position: Column) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(position.alias("i"), F.col(c).alias("y")))

    # Per segment: its length, and the outermost known points of each column.
    summary = local.groupBy(*by, SEGMENT).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max(known(c, F.col("_local"))).alias(f"_last_{c}") for c in cols],
        *[F.min(known(c, F.col("_local"))).alias(f"_first_{c}") for c in cols],
    )
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*by)
        .orderBy(F.col(SEGMENT).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = summary.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))

    def shifted(point: str) -> Column:
        p = F.col(point)
        return F.when(
            p.isNotNull(), F.struct((p["i"] + F.col("_before")).alias("i"), p["y"].alias("y"))
        )

    placed = placed.withColumns(
        {f"_{end}_{c}": shifted(f"_{end}_{c}") for c in cols for end in ("last", "first")}
    )
    border = placed.select(
        *by,
        SEGMENT,
        "_before",
        *[F.last(f"_last_{c}", True).over(earlier).alias(f"_prev_{c}") for c in cols],
        *[F.last(f"_first_{c}", True).over(later).alias(f"_next_{c}") for c in cols],
        F.row_number().over(_across(by)).alias("_nth"),
        F.row_number().over(Window.partitionBy(*by).orderBy(F.col(SEGMENT).desc())).alias("_rest"),
    ).where("_nth > 1 or _rest > 1").drop("_nth", "_rest")

    # Both directions use a growing frame; one that shrinks towards the end of
    # the partition would be recomputed for every row.
    indexed = _join_border(local, border, by).withColumn(
        "node_index", (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint")
    )
    upwards = _within(by, ["_local"]).rowsBetween(Window.unboundedPreceding, -1)
    downwards = (
        Window.partitionBy(*by, SEGMENT)
        .orderBy(F.col("_local").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = F.col("node_index")
    points = indexed.select(
        *indexed.columns,
        *[F.last(known(c, at), True).over(upwards).alias(f"_p_{c}") for c in cols],
        *[F.last(known(c, at), True).over(downwards).alias(f"_n_{c}") for c in cols],
    )

    def filled(c: str) -> Column:
        p = F.coalesce(F.col(f"_p_{c}"), F.col(f"_prev_{c}"))
        n = F.coalesce(F.col(f"_n_{c}"), F.col(f"_next_{c}"))
        default = defaults.get(c, defaults.get("default", 0.0))
        between = p["y"] + (at - p["i"]) * (n["y"] - p["y"]) / (n["i"] - p["i"])
        return F.coalesce(
            F.col(c),
            F.coalesce(between, n["y"], p["y"], F.lit(float(default))) + F.lit(float(epsilon)),
        ).alias(c)

    done = points.select(
        *[filled(c) if c in cols else F.col(c) for c in gappy.columns], "node_index"
    )
    return _widen(df, done, key, [*cols, "node_index"]).select(*df.columns, "node_index")

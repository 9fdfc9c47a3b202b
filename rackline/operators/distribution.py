"""Exact distributions per group: quantiles, describe, ECDF, box plots, bins.

The built-in exact ``percentile`` keeps every distinct value of a group in one
task.  The operators here first count equal values (combined before the
shuffle, so a value held by a third of the rows costs one row per task), then
number the distinct values with a running total that spreads one group over
many tasks (see :mod:`rackline.operators.ordered`).  Ranks, quantiles and the
ECDF are exact for any number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackline.functions.stats import count_where, null_if_nan
from rackline.operators.attach import attach_group, join_group
from rackline.operators.ordered import running_total, segmented
from rackline.sources.tables import materialise


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name="variable", value="value"):
    """Wide to long: one row per id and column."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in cols], name, value)


def doubles_long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by..., variable, value)`` with missing values removed."""
    wide = df.select(*by, *[null_if_nan(F.col(c).cast("double")).alias(c) for c in cols])
    return melt(wide, by, cols).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "n") -> DataFrame:
    """Rows per value, nulls excluded."""
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias(out))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def count_distinct(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def ranked_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value of each column and group.

    Columns: ``by..., variable, value``, its count ``n``, the rows up to and
    including it ``cum``, and the group's ``total`` rows, ``mean``, ``min``, ``max``.
    """
    keys = [*by, "variable"]
    counts = value_counts(doubles_long(df, cols, by), "value", keys)
    ranked = running_total(
        segmented(counts, keys, ["value"]),
        keys,
        ["value"],
        "n",
        "cum",
        {
            "total": (F.sum, F.col("n")),
            "weight": (F.sum, F.col("n") * F.col("value")),
            "min": (F.min, F.col("value")),
            "max": (F.max, F.col("value")),
        },
    )
    return ranked.withColumn("mean", F.col("weight") / F.col("total")).drop("weight")


def _quantile_name(q: float) -> str:
    return "p" + f"{100 * q:.4f}".rstrip("0").rstrip(".").replace(".", "_")


# Share of a group's rows on either side of a quantile that a first bracket spans, and the
# size of the sketches it comes from, whose rank error is about a third of it.
MARGIN = 0.002
SKETCH = 4096


def _sketched(long: DataFrame, keys: Sequence[str], qs: Sequence[float], margin: float) -> DataFrame:
    """Per group and column count, mean, deviation and ends, and bounds that should enclose
    its quantiles, from a sketch: one aggregate."""
    stats = long.groupBy(*keys).agg(
        F.count("value").alias("total"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", SKETCH).alias("sketch"),
    )

    def at(rank: float) -> Column:
        if rank <= 0 or rank >= 1:
            return F.col("min" if rank <= 0 else "max")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank)))

    bounds = [
        at(rank).alias(f"{end}_{j}")
        for j, q in enumerate(qs)
        for end, rank in (("low", q - margin), ("high", q + margin))
    ]
    return materialise(stats.select(*keys, "total", "mean", "std", "min", "max", *bounds))


def _bracketed(long: DataFrame, keys, sketched: DataFrame, qs: Sequence[float], names) -> DataFrame:
    """One row per group and column with its quantiles; null where a bracket missed its rank.

    Every value inside a bracket is itself, all values of a gap between brackets are one
    entry after the bracket below, so counted entries in order give exact ranks.
    """
    bounds = [f"{end}_{j}" for j in range(len(qs)) for end in ("low", "high")]
    bounded = join_group(long, sketched.select(*keys, "total", *bounds), keys)
    v, inside, under = F.col("value"), F.lit(False), [F.lit(None).cast("double")] * 2
    for j in range(len(qs)):
        inside = inside | v.between(F.col(f"low_{j}"), F.col(f"high_{j}"))
        under.append(F.when(F.col(f"high_{j}") < v, F.col(f"high_{j}")))
    entries = bounded.select(
        *keys, F.when(inside, v).otherwise(F.greatest(*under)).alias("value"), (~inside).alias("gap"), "total"
    )
    order = ["value", "gap"]
    counts = entries.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    placed = running_total(segmented(counts, keys, order), keys, order, "n", "cum")
    columns = []
    for q, name in zip(qs, names, strict=True):
        place = F.lit(float(q)) * (F.col("total") - 1)

        def value_at(rank: Column) -> Column:
            here = ~F.col("gap") & (F.col("cum") - F.col("n") <= rank) & (rank < F.col("cum"))
            return F.max(F.when(here, F.col("value")))

        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return placed.groupBy(*keys).agg(*columns)


def _quantiles(long: DataFrame, keys, qs: Sequence[float], names, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """Exact quantiles by brackets, which are widened until they hold their ranks; and the statistics."""
    while True:
        sketched = _sketched(long, keys, qs, margin)
        found = materialise(_bracketed(long, keys, sketched, qs, names))
        missed = reduce(lambda a, b: a | b, [F.col(f"`{name}`").isNull() for name in names])
        if margin >= 1 or found.where(missed).isEmpty():
            return found, sketched
        margin *= 10


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    by: Sequence[str] = (),
    margin: float = MARGIN,
) -> DataFrame:
    """Exact interpolated quantiles, one row per group and column, named ``p<percent>``.

    One pass over the table makes a sketch of every column, which gives a bracket around
    each wanted rank.  A second counts the rows between brackets, and only values inside are
    put in order, so no copy of the table is written and almost nothing is sorted.  The counts
    show whether the rank lies inside; if it does not, the brackets are widened, in the end to
    all values.

    Runs its jobs while it is called, as the next bracket depends on the last one.
    """
    long, keys = doubles_long(df, cols, by), [*by, "variable"]
    return _quantiles(long, keys, qs, [_quantile_name(q) for q in qs], margin)[0]


def describe(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), scale: float = 1.0
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max; missing values skipped.

    All but the quartiles comes from the pass that makes the sketches for them (see
    :func:`quantiles`).  ``scale`` converts units (60 for hours to minutes).
    """
    long, keys = doubles_long(df, cols, by), [*by, "variable"]
    found, sketched = _quantiles(long, keys, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    both = join_group(sketched.withColumnRenamed("total", "count"), found, keys)
    names = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return both.select(*keys, "count", *[(F.col(c) * scale).alias(c) for c in names])


def ecdf(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Every distinct value with its relative frequency and ``P(X <= value)``."""
    ranked = ranked_values(df, [col], by)
    return ranked.select(
        *by,
        F.col("value").alias(col),
        (F.col("n") / F.col("total")).alias("pdf"),
        (F.col("cum") / F.col("total")).alias("cdf"),
    )


def _fenced(df: DataFrame, cols: Sequence[str], by: Sequence[str]):
    """Quartiles per group and column; and counted values: those outside the fences each for
    itself (``value``), those inside as one entry with its ends ``first`` and ``last``."""
    long, keys = doubles_long(df, cols, by), [*by, "variable"]
    quartiles, _ = _quantiles(long, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    rows = join_group(long, quartiles, keys).select(
        *keys, F.when(~inside, F.col("value")).alias("value"), F.when(inside, F.col("value")).alias("kept")
    )
    counted = rows.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("kept").alias("first"), F.max("kept").alias("last")
    )
    return quartiles, counted, keys


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 quartile ranges of the
    box) and the number of rows and of distinct values outside the whiskers.

    Runs jobs while it is called, see :func:`quantiles`.  The table is read three times:
    materialise what is dear to compute.
    """
    quartiles, counted, keys = _fenced(df, cols, by)
    outside = F.col("value").isNotNull()
    ends = counted.groupBy(*keys).agg(
        F.min("first").alias("whisker_low"),
        F.max("last").alias("whisker_high"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_rows"),
        count_where(outside).alias("outlier_values"),
    )
    found = join_group(ends, quartiles, keys)
    return found.select(
        *keys, "q1", "median", "q3", "whisker_low", "whisker_high", "outlier_rows", "outlier_values"
    )


def box_outliers(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The distinct values outside the whiskers, with their row counts."""
    _, counted, keys = _fenced(df, cols, by)
    return counted.where("value IS NOT NULL").select(*keys, "value", "n")


def average_ranks(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rank of each distinct value; equal values share the mean of their ranks."""
    ranked = ranked_values(df, cols, by)
    return ranked.select(
        *by, "variable", "value", (F.col("cum") - (F.col("n") - 1) / 2.0).alias("rank")
    )


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All most frequent values of each column, as text, with their count."""
    keys = [*by, "variable"]
    long = melt(df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols]), by, cols)
    counts = value_counts(long, "value", keys)
    top = counts.groupBy(*keys).agg(F.max("n").alias("_top"))
    return attach_group(counts, top, keys).where(F.col("n") == F.col("_top")).drop("_top")


def column_totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum of every given column, one row per column."""
    sums = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    return melt(sums, [], cols, "variable", "total")


def winsorize(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), q: float = 0.9999
) -> DataFrame:
    """Cap each column at its exact q-quantile within the group."""
    name = _quantile_name(q)
    caps = (
        quantiles(df, cols, [q], by)
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("variable") == c, F.col(name))).alias(f"_cap_{c}") for c in cols])
    )
    if by:
        limited = attach_group(df, caps, by)
        limits = {c: F.col(f"_cap_{c}") for c in cols}
    else:
        # One row of limits for the whole table: constants.
        limited, row = df, caps.first()
        limits = {c: F.lit(row[f"_cap_{c}"]) for c in cols}
    capped = {c: F.when(F.col(c) > limits[c], limits[c]).otherwise(F.col(c)) for c in cols}
    return limited.withColumns(capped).select(*df.columns)


def histogram_density(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    width: int = 5,
    upper: int = 110,
) -> DataFrame:
    """Density over ``width``-wide bins from 0 to ``upper`` (last bin closed).

    Values are rounded half-even first; the density is relative to the rows in range.
    """
    long = doubles_long(df, cols, by).withColumn("value", F.bround("value", 0))
    last = upper // width - 1
    binned = long.where(F.col("value").between(0, upper)).groupBy(
        *by, "variable", F.least(F.floor(F.col("value") / width), F.lit(last)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = binned.groupBy(*by, "variable").agg(F.sum("n").alias("_total"))
    return attach_group(binned, totals, [*by, "variable"]).select(
        *by,
        "variable",
        (F.col("bin") * width).cast("bigint").alias("bin_left"),
        "n",
        (F.col("n") / (F.col("_total") * width)).alias("density"),
    )


def one_hot(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Add a 0/1 column per value, named after it."""
    return df.withColumns({v: F.when(F.col(col) == v, 1).otherwise(0) for v in values})


def shares(df: DataFrame, predicates: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Fraction of rows meeting each predicate; unknown counts as not met."""
    return df.groupBy(*by).agg(
        *[F.avg(F.when(p, 1.0).otherwise(0.0)).alias(name) for name, p in predicates.items()]
    )

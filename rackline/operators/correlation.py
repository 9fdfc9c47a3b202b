"""Correlation matrices in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackline.functions.stats import null_if_nan
from rackline.operators.attach import join_group
from rackline.operators.ordered import SEGMENT, segmented
from rackline.sources.tables import columns_of_type, materialise

#: Columns are taken in blocks: one row of an aggregate has the covariances of two blocks.
BLOCK = 4


def _matrix(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """All ordered pairs of the entries of the arrays ``v``, which have no nulls.

    Every row counts once for each pair of blocks, combined before the shuffle into the
    centred moments of its block pair, so that three columns and three hundred take the
    same plan, and only (number of block pairs) rows a task are moved.
    """
    count, blocks = len(names), -(-len(names) // BLOCK)
    width = min(BLOCK, count)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)),
            lambda a: F.transform(
                F.sequence(a, F.lit(blocks - 1)), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )

    def entry(block: str, i: int) -> Column:
        return F.get("v", F.col(block) * BLOCK + i)

    cells = [(i, j) for i in range(width) for j in range(width)]
    moments = (
        rows.select("v", F.inline(pairs))
        .groupBy("a", "b")
        .agg(*[F.covar_pop(entry("a", i), entry("b", j)).alias(f"c_{i}_{j}") for i, j in cells])
    )
    cell = [
        F.struct(
            (F.col("a") * BLOCK + i).alias("i"),
            (F.col("b") * BLOCK + j).alias("j"),
            F.col(f"c_{i}_{j}").alias("joint"),
        )
        for i, j in cells
    ]
    joint = materialise(moments.select(F.inline(F.array(*cell))).where(f"i <= j AND j < {count}"))
    own = joint.where("i = j")
    # From here on the tables have a row for each pair of columns.
    label = F.array(*[F.lit(n) for n in names])
    places = rows.sparkSession.range(count * count).select(
        F.floor(F.col("id") / count).cast("int").alias("p"), (F.col("id") % count).cast("int").alias("q")
    )
    low, high = F.least("p", "q"), F.greatest("p", "q")
    found = places.join(joint, (low == F.col("i")) & (high == F.col("j")), "left")
    for side in ("p", "q"):
        spread = own.select(F.col("i").alias(f"{side}_of"), F.sqrt("joint").alias(f"{side}_spread"))
        found = found.join(spread, F.col(side) == F.col(f"{side}_of"), "left")
    corr = F.col("joint") / F.nullif(F.col("p_spread") * F.col("q_spread"), F.lit(0.0))
    return found.select(F.get(label, F.col("p")).alias("x"), F.get(label, F.col("q")).alias("y"), corr.alias("corr"))


def _complete(df: DataFrame, cols: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """The key and the array ``v`` of the columns as doubles, of rows without missing values."""
    values = [null_if_nan(F.col(f"`{c}`").cast("double")) for c in cols]
    return df.select(*key, F.array(*values).alias("v")).where(F.forall("v", lambda x: x.isNotNull()))


def pearson_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all (double) columns over the complete rows.

    Columns: ``x, y, corr``; null where a column is constant.  A table without
    double columns gives no rows.
    """
    cols = list(cols or columns_of_type(df, T.DoubleType))
    if not cols:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    return _matrix(_complete(df, cols), cols)


def row_ranks(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key..., variable, rank``: the average rank of every entry of ``v`` within its place.

    One range partition by (place, value, key) orders all columns at once and spreads a
    value that very many rows share.  Windows run per place and segment; only a segment's
    first and last value can go on in another, and those are counted over all segments.
    """
    long = rows.select(*key, F.posexplode("v").alias("variable", "value"))
    ordered = segmented(long, ["variable"], ["value", *key])
    by = ["variable", SEGMENT]
    summary = materialise(
        ordered.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_rows"), F.min("value").alias("_low"), F.max("value").alias("_high")
        )
    )
    earlier = Window.partitionBy("variable").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    # At most two rows for each segment and variable of it.
    edges = placed.select("variable", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("value")).distinct()
    parts = (
        ordered.join(F.broadcast(edges), ["variable", "value"]).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    less = F.when(F.col("value") == F.col("_low"), 0).otherwise(F.col("_rows") - F.col("_n"))
    tied = parts.join(placed, by).select("variable", "value", SEGMENT, "_n", (F.col("_before") + less).alias("_less"))
    tied = tied.groupBy("variable", "value").agg(F.min_by("_less", SEGMENT).alias("_less"), F.sum("_n").alias("_n"))
    tied = tied.select("variable", "value", (F.col("_less") + (F.col("_n") + 1) / 2.0).alias("_edge_rank"))

    own = Window.partitionBy(*by).orderBy("value")
    local = ordered.select(
        *key,
        *by,
        "value",
        F.rank().over(own).alias("_first"),
        F.count(F.lit(1)).over(own.rangeBetween(Window.currentRow, Window.currentRow)).alias("_ties"),
    )
    inner = F.col("_before") + F.col("_first") + (F.col("_ties") - 1) / 2.0
    ranked = join_group(local, F.broadcast(placed.select(*by, "_before")), by)
    ranked = join_group(ranked, F.broadcast(materialise(tied)), ["variable", "value"])
    return ranked.select(*key, "variable", F.coalesce("_edge_rank", inner).alias("rank"))


def spearman_matrix(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks over the complete rows; ``key`` identifies a row."""
    # Moved as narrow rows: a row's ranks lie in as many places as it has columns, so lists
    # made before the shuffle would have one entry each, at several times the size.
    ranks = row_ranks(_complete(df, cols, key), key).repartition(*key)
    in_order = F.array_sort(F.collect_list(F.struct("variable", "rank")))
    wide = ranks.groupBy(*key).agg(F.transform(in_order, lambda s: s["rank"]).alias("v"))
    return _matrix(wide, list(cols))

"""JSON maps stored as text, such as ``{"0": 41.5, "1": 43}`` (slot -> value)."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_TYPE = "map<string,string>"


def parsed(col: str) -> Column:
    return F.from_json(F.col(col), MAP_TYPE)


def json_keys(df: DataFrame, col: str) -> DataFrame:
    """The distinct keys over all rows, sorted."""
    keys = df.select(F.explode(F.map_keys(parsed(col))).alias("key")).distinct()
    return keys.orderBy(F.length("key"), "key")


def json_long(df: DataFrame, col: str, data_type: str = "double") -> DataFrame:
    """One row per entry of the map, with ``key`` and ``value`` in place of ``col``.

    Serves any number of keys: nothing about them is known while the plan is built.
    Unreadable values are null; rows without entries give none.
    """
    rest = [c for c in df.columns if c not in (col, "key", "value")]
    entries = df.select(*rest, F.explode(parsed(col)).alias("key", "text"))
    return entries.select(*rest, "key", F.col("text").try_cast(data_type).alias("value"))


def json_widen(
    df: DataFrame, col: str, keys: Sequence[str], data_type: str = "double"
) -> DataFrame:
    """One column ``col-key`` per wanted key; a missing key or unreadable value is null.

    ``col`` itself becomes the parsed map.  :func:`json_keys` lists the keys there are.
    """
    as_map = df.withColumn(col, parsed(col))
    return as_map.select(
        "*", *[F.col(col)[F.lit(k)].try_cast(data_type).alias(f"{col}-{k}") for k in keys]
    )


def json_aggregate(
    df: DataFrame,
    col: str,
    wanted: Collection[str] = ("min", "mean", "max"),
    single_key: bool = False,
) -> DataFrame:
    """Row-wise statistics over the map's values, rounded to 2 digits, in place of ``col``.

    Missing values are skipped; the sum of none is 0, its mean null.  The values
    are aggregated inside the row, so the keys need not be known.  With
    ``single_key`` (tables whose maps have one key overall) the sum of none is null.
    """
    values = F.filter(
        F.transform(F.map_values(parsed(col)), lambda v: v.try_cast("double")),
        lambda v: v.isNotNull(),
    )
    values = F.coalesce(values, F.array().cast("array<double>"))
    total = F.round(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), 2)
    empty = F.size(values) == 0
    if single_key:
        total = F.when(~empty, total)
    stats = {
        "min": F.round(F.array_min(values), 2),
        "sum": total,
        "mean": F.round(F.when(~empty, total / F.size(values)), 2),
        "max": F.round(F.array_max(values), 2),
    }
    return df.select(
        *[c for c in df.columns if c != col],
        *[expr.alias(f"{col}-{name}") for name, expr in stats.items() if name in wanted],
    )


def json_leaves(df: DataFrame, col: str, levels: int = 8) -> DataFrame:
    """One row per value that is no object or array, anywhere in the JSON text of ``col``.

    In place of ``col`` come ``path`` (such as ``$.slots[2].power``), ``kind`` (the value's
    type) and ``value`` as text, null for a JSON null.  Objects and arrays nested deeper
    than ``levels`` come as a leaf each, with their JSON text; empty ones give nothing.
    Text that is no JSON gives no rows, whole values at the top have the path ``$``.
    """
    rest = [c for c in df.columns if c not in (col, "path", "kind", "value")]
    rows = df.select(*rest, F.lit("$").alias("path"), F.try_parse_json(F.col(col)).alias("_value")).where("_value IS NOT NULL")
    # Each step opens what still holds others; leaves pass through as they are.
    for _ in range(levels):
        opened = F.when(F.schema_of_variant("_value").rlike("^(OBJECT|ARRAY)"), F.col("_value"))
        rows = rows.withColumn("_open", opened)
        inner = df.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()).toDF("_pos", "_key", "_inner")
        step = F.when(F.col("_key").isNull(), F.format_string("[%d]", F.col("_pos"))).otherwise(
            F.concat(F.lit("."), F.col("_key"))
        )
        leaf = F.col("_open").isNull()
        rows = rows.lateralJoin(inner).where(leaf | F.col("_pos").isNotNull()).select(
            *rest,
            F.when(leaf, F.col("path")).otherwise(F.concat("path", step)).alias("path"),
            F.when(leaf, F.col("_value")).otherwise(F.col("_inner")).alias("_value"),
        )
    nothing = F.is_variant_null("_value")
    return rows.select(
        *rest,
        "path",
        F.when(nothing, "VOID").otherwise(F.schema_of_variant("_value")).alias("kind"),
        F.when(~nothing, F.col("_value").cast("string")).alias("value"),
    )

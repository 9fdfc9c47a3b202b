"""Arrivals, waiting and run times, failures and sizes of batch jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackline.functions import nodes, times
from rackline.operators.distribution import box_stats, shares
from rackline.sources.tables import materialise

PERIODS = {
    "day": "submit_day",
    "month": "month_of_year",
    "week": "week_of_year",
    "day_of_year": "day_of_year",
    "hour": "hour_of_year",
}


def jobs_enriched(jobs: DataFrame, gpu_nodes=nodes.GPU_NODES) -> DataFrame:
    """Jobs with class, plain state, waiting and run hours, node hours and rack.

    A negative run time is repaired here, once, for all analyses.
    """
    marked = nodes.mark_ml(jobs, "node", gpu_nodes)
    return marked.select(
        *[c for c in marked.columns if c != "state"],
        times.normalise_state(F.col("state")).alias("state"),
        times.wait_hours().alias("job_waiting_time"),
        times.repair_dst(times.run_hours()).alias("job_running_time"),
        times.node_hours().alias("node_hours"),
        nodes.rack_prefix(F.col("node")).alias("rack"),
    )


def jobs_per_period(enriched: DataFrame, period: str) -> DataFrame:
    """Jobs per class and submit period; only periods with jobs appear."""
    column = PERIODS[period]
    return (
        times.calendar_columns(enriched)
        .where(F.col(column).isNotNull())
        .groupBy("is_ml", column)
        .agg(F.count("id").alias("jobs"))
    )


def mean_jobs_per_period(enriched: DataFrame, period: str = "day") -> DataFrame:
    return (
        jobs_per_period(enriched, period)
        .groupBy("is_ml")
        .agg(F.avg("jobs").alias("mean_jobs"), F.count(F.lit(1)).alias("periods"))
    )


def box_jobs_per_period(
    enriched: DataFrame, periods: Sequence[str] = ("month", "week", "day_of_year", "hour")
) -> DataFrame:
    """Box statistics of the jobs per period, all period kinds in one pass.

    Each job contributes one row per kind to a combining count, so the input is
    scanned once for all of them.
    """
    dated = times.calendar_columns(enriched)
    kinds = F.array(
        *[
            F.struct(F.lit(p).alias("period"), F.col(PERIODS[p]).cast("string").alias("slot"))
            for p in periods
        ]
    )
    counts = (
        dated.select("is_ml", "id", F.inline(kinds))
        .where(F.col("slot").isNotNull())
        .groupBy("is_ml", "period", "slot")
        .agg(F.count("id").alias("jobs"))
    )
    return box_stats(materialise(counts), ["jobs"], ["is_ml", "period"]).drop(
        "variable", "outlier_rows", "outlier_values"
    )


def jobs_per_rack(enriched: DataFrame) -> DataFrame:
    """Jobs per class and rack; pseudo racks are left out of the generic class."""
    pseudo = (F.col("is_ml") == 0) & F.col("rack").isin(*nodes.PSEUDO_RACKS)
    return (
        enriched.where(F.col("rack").isNotNull() & ~pseudo)
        .groupBy("is_ml", "rack")
        .agg(F.count("id").alias("jobs"))
    )


def jobs_per_node(enriched: DataFrame, at_least: int = 100) -> DataFrame:
    """Jobs per class and node-list text, pseudo nodes and rare lists left out."""
    return (
        enriched.where(F.col("node").isNotNull() & ~F.col("node").isin(*nodes.PSEUDO_NODES))
        .groupBy("is_ml", "node")
        .agg(F.count("id").alias("jobs"))
        .where(F.col("jobs") >= at_least)
    )


def busiest_nodes(enriched: DataFrame, k: int = 5, at_least: int = 100) -> DataFrame:
    """The k busiest nodes per class; ties by name.

    Spark keeps only the first k rows of a class per task before the shuffle.
    """
    order = Window.partitionBy("is_ml").orderBy(F.col("jobs").desc(), F.col("node"))
    ranked = jobs_per_node(enriched, at_least).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= k)


def jobs_per_numnodes(enriched: DataFrame) -> DataFrame:
    return (
        enriched.where(F.col("numnodes").isNotNull())
        .groupBy("is_ml", F.col("numnodes").cast("int").alias("numnodes"))
        .agg(F.count("id").alias("jobs"))
        .orderBy("is_ml", "numnodes")
    )


def failures_by_hour(enriched: DataFrame) -> DataFrame:
    """Failed jobs per class and submit hour, with every hour of the day present."""
    spark = enriched.sparkSession
    dense = spark.range(24).select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("is_ml"), F.col("id").cast("int").alias("hour")
    )
    failed = (
        enriched.where(F.col("state") == "FAILED")
        .groupBy("is_ml", F.hour("submit_date").alias("hour"))
        .agg(F.count(F.lit(1)).alias("failed"))
    )
    return dense.join(failed, ["is_ml", "hour"], "left").na.fill(0, ["failed"])


def by_class_and_state(enriched: DataFrame) -> DataFrame:
    """Completed and failed jobs only, for statistics per class and state."""
    return enriched.where(F.col("state").isin("COMPLETED", "FAILED"))


def population_columns() -> list:
    """The job populations that are described: all, per class, per state, per both."""
    ml = F.when(F.col("is_ml") == 1, "ml").otherwise("generic")
    final = F.col("state").isin("COMPLETED", "FAILED")
    state = F.lower("state")
    return [
        F.lit("all"),
        ml,
        F.when(final, state),
        F.when(final, F.concat(ml, F.lit(" "), state)),
    ]


def with_populations(enriched: DataFrame) -> DataFrame:
    """One row per job and population it belongs to (at most four)."""
    return enriched.withColumn(
        "population", F.explode(F.array(*population_columns()))
    ).where(F.col("population").isNotNull())


def wait_run_shares(enriched: DataFrame) -> DataFrame:
    """Per population: jobs that waited or ran at most an hour, or ran at most 6 minutes."""
    predicates = {
        "wait_within_hour": F.col("job_waiting_time") <= 1,
        "run_within_hour": F.col("job_running_time") <= 1,
        "run_within_6_minutes": F.col("job_running_time") <= 6 / 60,
    }
    return shares(with_populations(enriched), predicates, ["population"])


def core_shares(enriched: DataFrame) -> DataFrame:
    """Per population: single-node jobs and jobs with 2, 3 or 16 cores."""
    predicates = {"single_node": F.col("numnodes") == 1}
    predicates |= {f"cores_{n}": F.col("numcores") == n for n in (2, 3, 16)}
    return shares(with_populations(enriched), predicates, ["population"])

"""Submissions, run time and energy of jobs by class and state.

Only jobs with samples are counted.  Energy is a job's mean sampled power share
times its full run time, per node.  The analyses start from a summary with one
row per (job, node), made from the joined table or from samples and jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackline.functions import nodes, times
from rackline.functions.stats import count_where
from rackline.operators import sweep
from rackline.operators.distribution import melt
from rackline.plans.integration import Sides, sides, with_concurrency
from rackline.sources.tables import materialise

METRICS = ("submissions", "job_runtime_seconds", "node_energy")

# Order in which job states are reported.
STATES = ("COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "OUT_OF_MEMORY", "NODE_FAIL")


def _over_jobs(shared: DataFrame) -> DataFrame:
    """One row per (job, node) from job-sample rows with a ``power_share``.

    The class follows from the node and the state from the job, so both are grouping
    keys; as aggregates, text would force a sort of all rows.
    """
    return shared.groupBy("slurm_id", "node", "gpu_node", "state").agg(
        F.try_divide(F.sum("power_share"), F.count("power_share")).alias("mean_power"),
        F.max(times.run_seconds()).alias("run_seconds"),
    )


def _with_share(counted: DataFrame) -> DataFrame:
    return counted.withColumn(
        "power_share", F.col("node_power_usage") / F.col("concurrent_job_count")
    )


def job_nodes(job_samples: DataFrame) -> DataFrame:
    """One row per (job, node): mean power share, run seconds, class and state.

    For the stored joined table, which is read twice; once, and without a shuffle of its
    rows, where it holds ``concurrent_job_count``, the number of rows of each instant.
    """
    counted = "concurrent_job_count" in job_samples.columns
    return _over_jobs(_with_share(job_samples if counted else with_concurrency(job_samples)))


#: Values that the class flag of a sample can have.
CLASSES = (0, 1, None)


def instants(samples: DataFrame) -> DataFrame:
    """One row per (node, timestamp): its samples, and of each class their number, that of
    readings, and the sum of the readings."""

    def of_class(flag, value: Column, function) -> Column:
        return function(F.when(F.col("gpu_node").eqNullSafe(F.lit(flag)), value))

    power = F.col("node_power_usage")
    return samples.groupBy("node", "timestamp").agg(
        F.count(F.lit(1)).alias("samples"),
        *[
            of_class(flag, value, function).alias(f"{name}_{flag}")
            for flag in CLASSES
            for name, value, function in (
                ("samples", F.lit(1), F.count),
                ("readings", power, F.count),
                ("power", power, F.sum),
            )
        ],
    )


def observed_job_nodes(
    samples: DataFrame, jobs: DataFrame, window: tuple[datetime, datetime] | None = None
) -> DataFrame:
    """As :func:`job_nodes`, straight from samples and jobs.

    The joined table has as many rows per sample as jobs ran at that moment.  Here
    samples and jobs never meet: a sweep over each node's time counts the jobs at every
    instant, and a job's mean is the difference of running sums at its two ends.  A job
    costs two rows on each of its nodes, however long it is.
    """
    return _swept_job_nodes(sides(samples, jobs, window))


def _swept_job_nodes(table: Sides) -> DataFrame:
    on_nodes = table.on_nodes().withColumn("run_seconds", times.run_seconds())
    values = {}
    for flag in CLASSES:
        share = F.col(f"power_{flag}") / (F.col("samples") * F.col("jobs"))
        values |= {
            f"samples_sum_{flag}": F.col(f"samples_{flag}"),
            f"readings_sum_{flag}": F.col(f"readings_{flag}"),
            f"share_sum_{flag}": F.when(F.col("jobs") > 0, share),
        }
    ends = sweep.sums_inside(
        instants(table.samples),
        on_nodes,
        by="node",
        at="timestamp",
        start="start_date",
        end="end_date",
        held="jobs",
        values=values,
    )
    by = ["slurm_id", "node", "state"]
    sums = ends.groupBy(*by).agg(F.max("run_seconds").alias("run_seconds"), *[F.sum(c).alias(c) for c in values])
    classes = F.array(
        *[
            F.struct(
                F.lit(flag).cast("int").alias("gpu_node"),
                F.col(f"samples_sum_{flag}").alias("samples"),
                F.try_divide(f"share_sum_{flag}", f"readings_sum_{flag}").alias("mean_power"),
            )
            for flag in CLASSES
        ]
    )
    return (
        sums.select(*by, "run_seconds", F.inline(classes))
        .where("samples > 0")
        .select("slurm_id", "node", "gpu_node", "state", "mean_power", "run_seconds")
    )


def per_job(summary: DataFrame) -> DataFrame:
    """One row per job: class, state, run seconds and energy over its nodes.

    The class is the largest flag over the job's nodes, so a job that touches a GPU
    node counts as a GPU job.
    """
    return summary.groupBy("slurm_id", "state").agg(
        F.max("gpu_node").alias("gpu_node"),
        F.max("run_seconds").alias("run_seconds"),
        F.sum(F.col("mean_power") * F.col("run_seconds")).alias("energy"),
    )


def one_row_per_job(job_samples: DataFrame | Sides) -> DataFrame:
    """Class, state and run seconds of every observed job.

    Of the two sides, a sweep finds which jobs have samples; no job meets a sample.
    """
    if isinstance(job_samples, Sides):
        job_samples, run = _swept_job_nodes(job_samples), F.col("run_seconds")
    else:
        run = times.run_seconds()
    return job_samples.groupBy("slurm_id", "state").agg(F.max("gpu_node").alias("gpu_node"), F.max(run).alias("run_seconds"))


def submissions_by_class_state(job_samples: DataFrame | Sides) -> DataFrame:
    return (
        one_row_per_job(job_samples)
        .groupBy("gpu_node", "state")
        .agg(F.count(F.lit(1)).alias("submissions"))
    )


def runtime_by_class_state(job_samples: DataFrame | Sides) -> DataFrame:
    return (
        one_row_per_job(job_samples)
        .groupBy("gpu_node", "state")
        .agg(F.sum("run_seconds").alias("job_runtime_seconds"))
    )


def energy_by_class_state(summary: DataFrame) -> DataFrame:
    """Energy per class and state from a (job, node) summary."""
    return per_job(summary).groupBy("gpu_node", "state").agg(F.sum("energy").alias("node_energy"))


def class_state_metrics(summary: DataFrame) -> DataFrame:
    """All three metrics in one pass over the jobs; no join of separate results."""
    return (
        per_job(summary)
        .groupBy("gpu_node", "state")
        .agg(
            F.count(F.lit(1)).alias("submissions"),
            F.sum("run_seconds").alias("job_runtime_seconds"),
            F.sum("energy").alias("node_energy"),
        )
    )


def energy_share(summary: DataFrame) -> DataFrame:
    """Energy per class and its percentage of the total (one row per class)."""
    per_class = per_job(summary).groupBy("gpu_node").agg(F.sum("energy").alias("node_energy"))
    total = F.sum("node_energy").over(Window.partitionBy())
    return per_class.withColumn("pct_energy", F.try_divide(F.col("node_energy") * 100, total))


def class_comparison(summary: DataFrame) -> DataFrame:
    """Per class: racks, nodes, energy, failed jobs, distinct jobs, run seconds.

    Racks, nodes, jobs and run time follow the class of the node a job ran on;
    energy and failures follow the class of the job.  All six numbers come from
    the (job, node) summary, which is written out because three aggregations use it.
    """
    summary = materialise(summary)
    by_node = (
        summary.select("gpu_node", "node")
        .distinct()
        .withColumn("rack", nodes.rack_regex(F.col("node")))
        .groupBy("gpu_node")
        .agg(
            F.countDistinct("rack").alias("rack_count"),
            F.count("node").alias("node_count"),
        )
    )
    by_job_row = (
        summary.groupBy("gpu_node", "slurm_id")
        .agg(F.max("run_seconds").alias("run_seconds"))
        .groupBy("gpu_node")
        .agg(
            F.count(F.lit(1)).alias("job_submissions"),
            F.sum("run_seconds").alias("job_runtime"),
        )
    )
    by_job = (
        per_job(summary)
        .groupBy("gpu_node")
        .agg(
            F.sum("energy").alias("job_energy"),
            count_where(F.col("state") == "FAILED").alias("job_failures"),
        )
    )
    return by_node.join(by_job_row, "gpu_node").join(by_job, "gpu_node")


COMPARED = ("rack_count", "node_count", "job_submissions", "job_failures", "job_runtime",
            "job_energy")


def normalise_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each column divided by its total (within ``by``).

    For result tables of a few rows: the total is a window over all of them.
    """
    total = Window.partitionBy(*by)
    return df.withColumns(
        {c: F.try_divide(F.col(c).cast("double"), F.sum(F.col(c).cast("double")).over(total))
         for c in cols}
    )


def percent_table(normalised: DataFrame, cols: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Shares as text such as ``66.67%``."""
    return normalised.select(
        *ids,
        *[F.concat(F.round(F.col(c) * 100, 2).cast("string"), F.lit("%")).alias(c) for c in cols],
    )


def class_label(df: DataFrame, flag: str = "gpu_node", out: str = "type") -> DataFrame:
    return df.withColumn(out, F.when(F.col(flag) == 1, "ML").otherwise("Generic"))


def melted_comparison(comparison: DataFrame) -> DataFrame:
    """Long form of the normalised comparison: (type, variable, value)."""
    shares = normalise_columns(comparison, COMPARED)
    return melt(class_label(shares), ["type"], COMPARED)


def pivot_mean(
    long: DataFrame, index: str, columns: str, values: str, order: Sequence[str], fill: float = 0.0
) -> DataFrame:
    """Long to wide: mean per cell, explicit column order, empty cells filled."""
    wide = long.groupBy(index).pivot(columns, list(order)).agg(F.avg(values))
    return wide.na.fill(fill, list(order))


def stack_offsets(
    long: DataFrame, index: str, columns: str, values: str, order: Sequence[str]
) -> DataFrame:
    """Left edge of each stacked bar: running sum over the earlier categories.

    For result tables: a window partition is one bar.
    """
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    rank = F.element_at(ranks, F.col(columns))
    before = (
        Window.partitionBy(index).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    )
    return long.withColumn("left_edge", F.coalesce(F.sum(values).over(before), F.lit(0.0)))


def state_matrix(
    metrics: DataFrame, cols: Sequence[str] = METRICS, states: Sequence[str] = STATES
) -> DataFrame:
    """Per class a metric x state matrix of shares, states in a fixed order."""
    shares = normalise_columns(metrics, cols, ["gpu_node"])
    long = melt(shares, ["gpu_node", "state"], cols, "metric", "share")
    return (
        long.groupBy("gpu_node", "metric")
        .pivot("state", list(states))
        .agg(F.max("share"))
        .na.fill(0.0, list(states))
    )

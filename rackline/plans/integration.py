"""Joining node samples with the jobs that ran on the node at that instant."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackline.functions import nodes, times
from rackline.functions.stats import count_where
from rackline.operators import sweep
from rackline.operators.joins import BUCKET_SECONDS, interval_join, interval_join_in_order, interval_join_listed, spread


def time_ranges(jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """Per source the first and last instant, one row each."""
    spans = jobs.select(
        F.lit("jobs").alias("source"),
        F.col("start_date").alias("first"),
        F.col("end_date").alias("last"),
    ).unionByName(
        samples.select(
            F.lit("samples").alias("source"),
            F.col("timestamp").alias("first"),
            F.col("timestamp").alias("last"),
        )
    )
    return spans.groupBy("source").agg(
        F.min("first").alias("first_time"), F.max("last").alias("last_time")
    )


def date_coverage(jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """Time range of both sources and of their intersection, with inclusive days."""
    ranges = time_ranges(jobs, samples)
    common = ranges.agg(
        F.lit("intersection").alias("source"),
        F.max("first_time").alias("first_time"),
        F.min("last_time").alias("last_time"),
    )
    whole_days = F.timestamp_diff("DAY", F.col("first_time"), F.col("last_time"))
    return ranges.unionByName(common).withColumn("days", whole_days + 1)


def common_window(jobs: DataFrame, samples: DataFrame) -> tuple[datetime, datetime]:
    """Bounds of the intersection: two values, fetched so that the filters made
    from them are constants that reach the parquet scan."""
    row = time_ranges(jobs, samples).agg(F.max("first_time"), F.min("last_time")).first()
    return row[0], row[1]


def restrict_to_window(
    jobs: DataFrame, samples: DataFrame, window: tuple[datetime, datetime] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Jobs wholly inside and samples inside the closed common time window."""
    low, high = window or common_window(jobs, samples)

    def like(column, df):
        kind = df.schema[column].dataType
        return F.lit(low).cast(kind), F.lit(high).cast(kind)

    job_low, job_high = like("start_date", jobs)
    at_low, at_high = like("timestamp", samples)
    return (
        jobs.where((F.col("start_date") >= job_low) & (F.col("end_date") <= job_high)),
        samples.where(F.col("timestamp").between(at_low, at_high)),
    )


def spread_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs over all shuffle partitions, by id: usually one small file, but its rows
    multiply when node lists and time buckets are exploded and matched."""
    return spread(jobs, "id")


def job_side(jobs: DataFrame, taken: Sequence[str] = ()) -> DataFrame:
    """Jobs ready for the join: node array, plain state, renamed id, all other columns.

    Columns whose names are ``taken`` by the samples get the prefix ``slurm_``.
    """
    changed = ("id", "node", "state")
    return jobs.select(
        F.col("id").alias("slurm_id"),
        nodes.expand_nodes(F.col("node")).alias("slurm_nodes"),
        times.normalise_state(F.col("state")).alias("state"),
        *[
            F.col(c).alias(f"slurm_{c}" if c in taken else c)
            for c in jobs.columns
            if c not in changed
        ],
    )


def named_samples(samples: DataFrame) -> DataFrame:
    """Samples with their row id, ``id`` in the stored tables, as ``prom_id``."""
    return samples if "prom_id" in samples.columns else samples.withColumnRenamed("id", "prom_id")


@dataclass(frozen=True)
class Sides:
    """The joined table before its rows are paired: samples, and jobs with node arrays.

    The joined table has a row for each sample and each job running then, so it grows with
    the product of the two.  Analyses that ask for numbers per instant or per job take the
    sides instead of it, and pair only what they return.
    """

    samples: DataFrame
    jobs: DataFrame

    def pairs(self, columns: Sequence[str] | None = None, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
        """The joined table; name the ``columns`` where few are wanted, as these are listed faster."""
        if columns is None:
            return interval_join(self.samples, self.jobs, bucket_seconds=bucket_seconds)
        return interval_join_listed(self.samples, self.jobs, columns, bucket_seconds=bucket_seconds)

    def pairs_in_order(self, columns: Sequence[str] | None = None, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
        """The joined table, or ``columns`` of it, made in order of node and time, block by block."""
        columns = columns or [*self.samples.columns, *self.jobs.columns]
        return interval_join_in_order(self.samples, self.jobs, columns, bucket_seconds=bucket_seconds)

    def counted(self, out: str = "concurrent_job_count") -> Sides:
        """The sides with the number of joined rows of its instant at every sample that has any."""
        counts = self.instants().select("node", "timestamp", F.col("concurrent_job_count").alias(out))
        return Sides(self.samples.join(counts, ["node", "timestamp"]), self.jobs)

    def on_nodes(self) -> DataFrame:
        """One row per job and node, as the join would match it."""
        return self.jobs.select(
            "slurm_id", "state", "start_date", "end_date", F.explode(F.array_distinct("slurm_nodes")).alias("node")
        )

    def held_at(self, points: DataFrame, counts: dict[str, Column], on_nodes: DataFrame | None = None) -> DataFrame:
        """Points, distinct by node and instant, with sums of ``counts`` over the jobs running then."""
        return sweep.held_at(
            points,
            (self.on_nodes() if on_nodes is None else on_nodes).withColumns(counts),
            by="node",
            at="timestamp",
            start="start_date",
            end="end_date",
            counts=list(counts),
        )

    def instants(self) -> DataFrame:
        """Nodes and instants with joined rows: ``samples``, ``jobs``, and the rows, their product."""
        held = self.held_at(instants(self.samples), {"jobs": F.lit(1)}).where("jobs > 0")
        return held.withColumn("concurrent_job_count", F.col("samples") * F.col("jobs"))


def instants(samples: DataFrame) -> DataFrame:
    """One row per node and instant with the number of its samples."""
    return samples.groupBy("node", "timestamp").agg(F.count(F.lit(1)).alias("samples"))


def sides(samples: DataFrame, jobs: DataFrame, window: tuple[datetime, datetime] | None = None) -> Sides:
    """Samples and jobs ready to be joined.  The bounds of the common time window are
    fetched while this is called, unless given."""
    inside_jobs, inside_samples = restrict_to_window(jobs, named_samples(samples), window)
    return Sides(inside_samples, job_side(spread_jobs(inside_jobs), inside_samples.columns))


def integrate(
    samples: DataFrame,
    jobs: DataFrame,
    window: tuple[datetime, datetime] | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
    counted: str | None = None,
    in_order: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The joined table: one row per sample and job running on its node then.

    All columns of both sides are available; unused ones are pruned from the
    scans, so no second join is needed to get wide columns back.  The bounds of the
    common time window are fetched while this is called, unless given.  A column
    ``counted`` gets the number of rows of the same node and instant, known before
    rows are paired, so that who reads the stored table need not shuffle it to count.
    ``in_order`` makes the rows clustered by node and time, for ``write_joined``; name the
    ``columns`` then if not all are wanted, as they are carried through the join.
    """
    table = sides(samples, jobs, window)
    table = table.counted(counted) if counted else table
    if in_order:
        return table.pairs_in_order(columns, bucket_seconds)
    return table.pairs(columns, bucket_seconds)


def concurrency(job_samples: DataFrame, out: str = "concurrent_job_count") -> DataFrame:
    """Number of rows per node and instant."""
    return job_samples.groupBy("node", "timestamp").agg(F.count(F.lit(1)).alias(out))


def with_concurrency(
    job_samples: DataFrame | Sides,
    out: str = "concurrent_job_count",
    bucket_seconds: int = BUCKET_SECONDS,
    columns: Sequence[str] | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda counted: counted,
) -> DataFrame:
    """Add the number of rows of the same node and instant.

    Counted with a combining aggregate and joined back, so that an instant with
    very many rows is not gathered in one window partition.  The table is read
    twice: pass the stored joined table rather than the join itself.  Of the two
    sides, samples get the number before they meet their jobs, and what ``finish`` makes of
    them with it is made once for a sample, not for each of its rows.  ``columns`` are those
    wanted, all if not given.
    """
    if isinstance(job_samples, Sides):
        counted = job_samples.counted(out)
        return Sides(finish(counted.samples), counted.jobs).pairs(columns, bucket_seconds)
    counted = finish(job_samples.join(concurrency(job_samples, out), ["node", "timestamp"], "left"))
    return counted.select(*columns) if columns else counted


def state_counts(job_samples: DataFrame | Sides, states: list[str]) -> DataFrame:
    """Jobs per state at each node and instant, and their total.

    Of the two sides, jobs are counted by a sweep, and no job meets a sample.
    """
    if isinstance(job_samples, Sides):
        own = {f"_in_{i}": F.when(F.col("state") == s, 1).otherwise(0) for i, s in enumerate(states)}
        held = job_samples.held_at(instants(job_samples.samples), {**own, "_any": F.lit(1)}).where("_any > 0")
        rows = {s: F.col("samples") * F.col(c) for c, s in zip(own, states, strict=True)}
        return held.select(
            "node", "timestamp", *[r.alias(s) for s, r in rows.items()], sum(rows.values()).alias("total_jobs_running")
        )
    return job_samples.groupBy("node", "timestamp").agg(
        *[count_where(F.col("state") == s).alias(s) for s in states],
        count_where(F.col("state").isin(*states)).alias("total_jobs_running"),
    )


def job_span_stats(jobs: DataFrame) -> DataFrame:
    """Counts and hours of jobs under 30 s, within one day and over several days.

    Shares of hours: short jobs relative to all three sums, the others relative
    to the sum of one-day and several-day jobs.
    """
    seconds = times.run_seconds()
    one_day = F.to_date("start_date") == F.to_date("end_date")
    many_days = F.to_date("start_date") < F.to_date("end_date")
    kinds = {"short": seconds < 30, "one_day": one_day, "many_days": many_days}

    def hours(p):
        return F.coalesce(F.sum(F.when(p, seconds / 3600.0)), F.lit(0.0))

    totals = jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        *[count_where(p).alias(f"jobs_{k}") for k, p in kinds.items()],
        *[hours(p).alias(f"hours_{k}") for k, p in kinds.items()],
    )
    two = F.col("hours_one_day") + F.col("hours_many_days")
    return totals.select(
        "*",
        *[F.try_divide(F.col(f"jobs_{k}") * 100.0, F.col("jobs")).alias(f"pct_jobs_{k}")
          for k in kinds],
        F.try_divide(F.col("hours_short") * 100, F.col("hours_short") + two).alias(
            "pct_hours_short"
        ),
        F.try_divide(F.col("hours_one_day") * 100, two).alias("pct_hours_one_day"),
        F.try_divide(F.col("hours_many_days") * 100, two).alias("pct_hours_many_days"),
    )


def longest_node_lists(jobs: DataFrame, k: int = 5) -> DataFrame:
    """The k jobs with the longest node-list text; ties by id."""
    return (
        jobs.orderBy(F.length("node").desc(), F.col("id"))
        .limit(k)
        .withColumn("nodez", nodes.expand_nodes(F.col("node")))
    )

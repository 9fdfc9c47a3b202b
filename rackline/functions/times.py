"""Job durations, calendar columns and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds_between(start: str, end: str) -> Column:
    """Seconds with their fraction, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1e6


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", origin, ts) / F.lit(1_000_000))


def run_seconds() -> Column:
    """Whole seconds, of which either end is rounded down first."""
    return epoch_seconds(F.col("end_date")) - epoch_seconds(F.col("start_date"))


def run_hours() -> Column:
    return seconds_between("start_date", "end_date") / 3600.0


def wait_hours() -> Column:
    return seconds_between("submit_date", "start_date") / 3600.0


def repair_dst(hours: Column) -> Column:
    """Negative run times come from the autumn clock change: add the lost hour."""
    return F.when(hours < 0, hours + 1).otherwise(hours)


def node_hours() -> Column:
    return F.col("numnodes") * repair_dst(run_hours())


def normalise_state(state: Column) -> Column:
    """``CANCELLED by <user>`` and the like become ``CANCELLED``; null stays."""
    return F.when(state.startswith("CANCELLED"), F.lit("CANCELLED")).otherwise(state)


def week_of_year_sunday(ts: Column) -> Column:
    """Two-digit week number whose weeks start on Sunday, ``00`` before the first."""
    week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7)
    return F.lpad(week.cast("string"), 2, "0")


def since_new_year(ts: Column, unit: str) -> Column:
    """Whole units elapsed since January 1st of the same year."""
    days = F.dayofyear(ts).cast("bigint") - 1
    hours = days * 24 + F.hour(ts)
    minutes = hours * 60 + F.minute(ts)
    by_unit = {
        "HOUR": hours,
        "MINUTE": minutes,
        "SECOND": minutes * 60 + F.floor(F.second(ts)),
    }
    return by_unit[unit]


def calendar_columns(df: DataFrame, ts: str = "submit_date") -> DataFrame:
    t = F.col(ts)
    return df.select(
        "*",
        F.to_date(t).alias("submit_day"),
        F.hour(t).alias("submit_hour_of_day"),
        F.weekday(t).alias("submit_day_of_week"),
        F.month(t).alias("month_of_year"),
        week_of_year_sunday(t).alias("week_of_year"),
        F.dayofyear(t).alias("day_of_year"),
        since_new_year(t, "HOUR").alias("hour_of_year"),
        since_new_year(t, "MINUTE").alias("minute_of_year"),
        since_new_year(t, "SECOND").alias("second_of_year"),
    )


def explode_days(df: DataFrame, start: str, end: str, out: str = "running_day") -> DataFrame:
    """One row per calendar day touched by ``[start, end]``; real dates, so a job
    over New Year gives consecutive days.  Reversed or open intervals give none."""
    days = F.sequence(F.to_date(F.col(start)), F.to_date(F.col(end)), F.expr("interval 1 day"))
    return df.where(F.col(start) <= F.col(end)).withColumn(out, F.explode(days))

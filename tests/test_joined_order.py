"""The joined table made in order: the same rows, written without a shuffle or a sort of them."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from test_joins import JOB, SAMPLE, _jobs, _samples

from checks.queries import REGISTRY
from rackline.plans import integration
from rackline.sources import tables

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    samples, jobs = _samples(rng), _jobs(rng)
    samples += samples[:5]
    # Jobs of weeks and years use wider buckets; some meet no sample, some have no state.
    for i, days in enumerate((5, 40, 900), 1):
        jobs.append((90_000 + i, *jobs[i][1:2], START - timedelta(days=days), START + timedelta(days=days), None, *jobs[i][5:]))
    return integration.Sides(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB))


def _rows(df):
    return sorted(str(r) for r in df.collect())


def test_the_rows_are_those_of_the_join(sides):
    want = sides.pairs()
    found = sides.pairs_in_order()
    assert found.columns == want.columns and found.dtypes == want.dtypes
    rows = _rows(want)
    assert len(rows) > 500 and _rows(found) == rows
    assert _rows(sides.pairs_in_order(bucket_seconds=600)) == rows
    some = ["slurm_id", "node", "state"]
    assert _rows(sides.pairs_in_order(some)) == _rows(want.select(*some))
    counted = sides.counted()
    assert _rows(counted.pairs_in_order()) == _rows(counted.pairs())


def test_nothing_meets_on_empty_sides(sides):
    none = integration.Sides(sides.samples.where("false"), sides.jobs)
    assert none.pairs_in_order().collect() == []
    none = integration.Sides(sides.samples, sides.jobs.where("false"))
    assert none.pairs_in_order().collect() == []


def _busy(spark, samples, jobs):
    """One node within six hours; every job but the first and last few runs at most instants."""
    at = F.lit(START).cast("timestamp_ntz")
    points = spark.range(samples).select(
        F.col("id").alias("prom_id"),
        F.lit("r1n1").alias("node"),
        (at + F.make_dt_interval(secs=(F.col("id") * 20_000 / samples).cast("decimal(18,6)"))).alias("timestamp"),
        F.rand(3).alias("node_power_usage"),
    )
    begun = (at + F.make_dt_interval(secs=(F.rand(4) * 1000).cast("decimal(18,6)"))).alias("start_date")
    ended = (at + F.make_dt_interval(secs=(F.rand(5) * 1000 + 19_000).cast("decimal(18,6)"))).alias("end_date")
    runs = spark.range(jobs).select(
        F.xxhash64("id").alias("slurm_id"), F.array(F.lit("r1n1")).alias("slurm_nodes"), F.lit("FAILED").alias("state"), begun, ended
    )
    return integration.Sides(points, runs)


def _stored(sides, path):
    tables.write_joined(sides.pairs_in_order(), path, in_order=True)
    return sum(f.stat().st_size for f in Path(path).glob("*.parquet"))


def test_the_stored_table_grows_with_the_sides_not_with_their_product(spark, tmp_path):
    small = _stored(_busy(spark, 250, 250), str(tmp_path / "small"))
    large = _stored(_busy(spark, 1000, 1000), str(tmp_path / "large"))
    back = tables.load(spark, str(tmp_path / "large"))
    assert back.count() > 900_000
    assert large < 6 * small  # 16 times the rows
    rows = [(r.timestamp, r.start_date) for r in back.select("timestamp", "start_date").limit(20_000).collect()]
    assert rows == sorted(rows)


def _writes(spark, base, name, monkeypatch):
    """Plans of the joined tables that a query writes."""
    plans = []

    def seen(write):
        def wrapped(self, *args, **kwargs):
            if {"prom_id", "slurm_id"} <= {"prom_id" if c == "id" else c for c in self._df.columns}:
                plans.append(self._df._jdf.queryExecution().executedPlan().toString())
            return write(self, *args, **kwargs)

        return wrapped

    for way in ("parquet", "saveAsTable"):
        monkeypatch.setattr(DataFrameWriter, way, seen(getattr(DataFrameWriter, way)))
    with tables.intermediate_tables(spark):
        assert REGISTRY[name](spark, base).collect()
    return plans


@pytest.mark.parametrize("name", ["joined_written", "energy_from_joined", "named_tables"])
def test_pairs_are_written_as_they_are_made(spark, base, name, monkeypatch):
    plans = _writes(spark, base, name, monkeypatch)
    assert len(plans) == 1
    assert "Join" in plans[0]
    joined = plans[0][: plans[0].index("Join")]
    assert joined.count("inline") == 2
    # Blocks may be sorted before they are unfolded; pairs are what is above.
    pairs = joined[: joined.rindex("inline")]
    assert "Exchange" not in pairs and "Sort" not in pairs

"""Pairs listed from packed intervals: the same rows, in bounded pieces, without work on each pair."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_joins import JOB, SAMPLE, _jobs, _samples

from checks.queries import REGISTRY
from rackline.operators import joins
from rackline.plans import integration

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(8)
    samples, jobs = _samples(rng), _jobs(rng)
    samples += samples[:5]
    # Jobs of weeks and years use wider buckets.
    for i, days in enumerate((5, 40, 900), 1):
        jobs.append((90_000 + i, *jobs[i][1:2], START - timedelta(days=days), START + timedelta(days=days), None, *jobs[i][5:]))
    return integration.Sides(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB))


def _rows(df):
    return sorted(str(r) for r in df.collect())


@pytest.mark.parametrize(("pack", "bucket"), [(1, joins.BUCKET_SECONDS), (3, 600), (3, 10 * 86400), (1024, joins.BUCKET_SECONDS)])
def test_listed_pairs_are_those_of_the_join(sides, monkeypatch, pack, bucket):
    monkeypatch.setattr(joins, "PACK", pack)
    monkeypatch.setattr(joins, "RUN", 1 + pack % 8)
    want = sides.pairs()
    rows = _rows(want)
    found = sides.pairs(want.columns, bucket)
    assert found.dtypes == want.dtypes
    assert len(rows) > 500 and _rows(found) == rows
    assert _rows(sides.pairs_in_order(bucket_seconds=bucket)) == rows
    some = ["state", "slurm_id", "prom_id"]
    assert _rows(sides.pairs(some, bucket)) == _rows(want.select(*some))


def test_nothing_is_listed_on_empty_sides(sides):
    some = ["prom_id", "slurm_id"]
    assert integration.Sides(sides.samples.where("false"), sides.jobs).pairs(some).collect() == []
    assert integration.Sides(sides.samples, sides.jobs.where("false")).pairs(some).collect() == []


def _above_the_join(spark, base, name):
    plan = REGISTRY[name](spark, base)._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join Inner")]


@pytest.mark.parametrize("name", ["concurrent_jobs", "high_load_rows", "peer_state_counts"])
def test_what_one_side_has_is_made_once_not_for_each_pair(spark, base, name):
    above = _above_the_join(spark, base, name)
    assert "inline(_intervals" in above
    for work in ("round(", "timestampdiff", " / ", "CASE WHEN"):
        assert work not in above


def test_packs_are_bounded(spark):
    at = F.lit(START).cast("timestamp_ntz")
    runs = spark.range(5000).select(F.col("id").alias("slurm_id"), F.lit("r1").alias("_key"), F.lit(1).alias("_bucket"), at.alias("s"), at.alias("e"))
    packs = joins._packed(runs, "s", "e", ["slurm_id"]).select(F.size("_intervals").alias("n")).collect()
    assert sum(r.n for r in packs) == 5000 and max(r.n for r in packs) <= joins.PACK

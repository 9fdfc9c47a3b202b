"""Job, hardware and GPU analyses on literal tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rackline.plans import energy, gpu, hardware, integration, jobs

DAY = datetime(2024, 3, 3)


def _job(i, node="r10n1", submit=DAY, wait=1.0, run=2.0, state="COMPLETED", numnodes=1, cores=2):
    start = submit + timedelta(hours=wait)
    return (i, node, submit, start, start + timedelta(hours=run), state, numnodes, cores)


@pytest.fixture
def build(spark):
    schema = (
        "id int, node string, submit_date timestamp_ntz, start_date timestamp_ntz, "
        "end_date timestamp_ntz, state string, numnodes int, numcores int"
    )
    return lambda rows: spark.createDataFrame(rows, schema)


def test_enriched(build):
    df = build([_job(1, "r10n1,r28n1", run=-0.5, numnodes=2, state="CANCELLED by 9"), _job(2)])
    rows = {r.id: r for r in jobs.jobs_enriched(df).collect()}
    assert (rows[1].is_ml, rows[1].state, rows[1].rack) == (1, "CANCELLED", "r10")
    assert (rows[1].job_waiting_time, rows[1].job_running_time, rows[1].node_hours) == (1, 0.5, 1)
    assert (rows[2].is_ml, rows[2].node_hours) == (0, 2.0)


def test_periods_and_failures(build):
    rows = [_job(i, submit=DAY + timedelta(hours=i), state="FAILED" if i % 2 else "COMPLETED")
            for i in range(30)]
    rows.append((99, "r10n1", None, None, None, "FAILED", 1, 1))
    enriched = jobs.jobs_enriched(build(rows))
    days = {str(r.submit_day): r.jobs for r in jobs.jobs_per_period(enriched, "day").collect()}
    assert days == {"2024-03-03": 24, "2024-03-04": 6}
    mean = jobs.mean_jobs_per_period(enriched).first()
    assert (mean.mean_jobs, mean.periods) == (15.0, 2)
    weeks = {r.week_of_year: r.jobs for r in jobs.jobs_per_period(enriched, "week").collect()}
    assert weeks == {DAY.strftime("%U"): 30}
    failed = {(r.is_ml, r.hour): r.failed for r in jobs.failures_by_hour(enriched).collect()}
    assert len(failed) == 48
    assert [failed[0, h] for h in range(7)] == [0, 2, 0, 2, 0, 2, 0]
    assert sum(v for (ml, _), v in failed.items() if ml == 1) == 0


def test_racks_and_nodes(build):
    names = ["None assigned", "software 1", "r10n1", "r10n1", "r10n2", "r28n1"]
    enriched = jobs.jobs_enriched(build([_job(i, n) for i, n in enumerate(names)]))
    racks = {(r.is_ml, r.rack): r.jobs for r in jobs.jobs_per_rack(enriched).collect()}
    assert racks == {(0, "r10"): 3, (1, "r28"): 1}
    top = jobs.busiest_nodes(enriched, k=1, at_least=1).orderBy("is_ml").collect()
    assert [(r.is_ml, r.node, r.jobs, r.place) for r in top] == [
        (0, "r10n1", 2, 1), (1, "r28n1", 1, 1)
    ]
    assert jobs.jobs_per_node(enriched, at_least=2).count() == 1


def test_shares_per_population(build):
    rows = [_job(1, wait=0.5, run=0.05), _job(2, wait=2, run=0.5, state="FAILED", cores=16),
            _job(3, "r28n1", wait=0.5, run=3, state="FAILED", numnodes=2, cores=3)]
    enriched = jobs.jobs_enriched(build(rows))
    shares = {r.population: r for r in jobs.wait_run_shares(enriched).collect()}
    assert set(shares) == {"all", "generic", "ml", "completed", "failed", "generic completed",
                           "generic failed", "ml failed"}
    assert shares["generic"].wait_within_hour == 0.5
    assert shares["all"].run_within_6_minutes == pytest.approx(1 / 3)
    cores = {r.population: r for r in jobs.core_shares(enriched).collect()}
    assert (cores["failed"].cores_16, cores["failed"].cores_3) == (0.5, 0.5)
    assert cores["ml"].single_node == 0.0


def test_box_of_counts(build):
    rows, i = [], 0
    for day, n in enumerate([2, 4, 4, 5, 60]):
        for _ in range(n):
            rows.append(_job(i, submit=DAY + timedelta(days=day)))
            i += 1
    found = jobs.box_jobs_per_period(jobs.jobs_enriched(build(rows)), ["day_of_year"]).first()
    assert (found.q1, found.median, found.q3) == (4.0, 4.0, 5.0)
    # With a box from 4 to 5 the whiskers end at 2.5 and 6.5: both 2 and 60 lie outside.
    assert (found.whisker_low, found.whisker_high) == (4.0, 5.0)


def test_job_spans(build):
    rows = [_job(1, submit=DAY, wait=0, run=10 / 3600), _job(2, submit=DAY, wait=0, run=5),
            _job(3, submit=DAY, wait=20, run=8)]
    row = integration.job_span_stats(build(rows)).first()
    assert (row.jobs, row.jobs_short, row.jobs_one_day, row.jobs_many_days) == (3, 1, 2, 1)
    one, many, short = 5 + 10 / 3600, 8.0, 10 / 3600
    assert row.pct_hours_short == pytest.approx(100 * short / (short + one + many))
    assert row.pct_hours_one_day == pytest.approx(100 * one / (one + many))
    top = integration.longest_node_lists(build([_job(1), _job(2, "r10n[1-3]")]), 1).first()
    assert top.nodez == ["r10n1", "r10n2", "r10n3"]


def test_spans_over_new_year(build):
    row = integration.job_span_stats(build([_job(1, submit=datetime(2023, 12, 31, 22), run=4)]))
    assert row.first().jobs_many_days == 1


def test_reshaping(spark):
    long = spark.createDataFrame(
        [("Generic", "jobs", 0.25), ("ML", "jobs", 0.75), ("ML", "energy", 1.0)],
        "type string, variable string, value double",
    )
    wide = energy.pivot_mean(long, "variable", "type", "value", ["Generic", "ML"])
    assert {r.variable: (r.Generic, r.ML) for r in wide.collect()} == {
        "jobs": (0.25, 0.75), "energy": (0.0, 1.0)
    }
    edges = energy.stack_offsets(long, "variable", "type", "value", ["Generic", "ML"])
    assert {(r.variable, r.type): r.left_edge for r in edges.collect()} == {
        ("jobs", "Generic"): 0.0, ("jobs", "ML"): 0.25, ("energy", "ML"): 0.0
    }
    table = spark.createDataFrame([("ML", 2.0), ("Generic", 1.0)], "type string, v double")
    text = energy.percent_table(energy.normalise_columns(table, ["v"]), ["v"], ["type"])
    assert {r.type: r.v for r in text.collect()} == {"ML": "66.67%", "Generic": "33.33%"}


def test_rack_hardware(spark):
    rows = [(f"r28n{i}", 2, 32, 250, 100, 200, 4, 1000, 50) for i in (1, 2, 9)]
    df = spark.createDataFrame(rows, ["node", *hardware.ATTRIBUTES])
    row = hardware.rack_hardware(df).first()
    assert (row.rack, row.node_count_sum, row.cpu_count_sum, row.gpu_rack) == ("r28", 3, 6, 1)
    seen = spark.createDataFrame([("r28n1",), ("r28n1",), ("r99n1",)], "node string")
    assert [r.node for r in hardware.observed_hardware(df, seen).collect()] == ["r28n1"]


@pytest.mark.parametrize(
    ("x", "label"),
    [(0.0, None), (0.1, 1), (1.0, 1), (1.0001, 2), (170.0, 170), (170.5, None), (-1.0, None),
     (None, None)],
)
def test_unit_bins(spark, x, label):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(gpu.unit_bin(F.col("x"), 170).alias("b")).first().b == label


def test_gpu_cards(spark):
    rows = [
        ("n1", 1.0, 0.98, 0.5, 0.6), ("n1", 0.999, 0.97, 0.7, 0.6), ("n2", 0.1, 1.0, 0.1, 0.4),
        ("n2", None, 1.0, 0.1, 0.2),
    ]
    df = spark.createDataFrame(
        rows, "node string, power_0 double, power_1 double, temp_0 double, temp_1 double"
    ).withColumn("gpu_count", F.lit(4))
    busy = gpu.all_slots_at_least(df, 0.95)
    assert busy.count() == 2
    assert gpu.all_slots_at_least(df, 0.0).count() == 3
    binned = gpu.binned_temperature(gpu.all_slots_at_least(df, 0.0))
    assert binned.count() == 340
    by_bin = {(r.slot, r.power_bin): r.mean_temp for r in binned.collect()}
    assert by_bin[0, 100] == pytest.approx(60.0)
    assert by_bin[1, 100] == pytest.approx(40.0)
    assert by_bin[0, 50] is None
    extremes = gpu.temperature_at(binned).first()
    assert (extremes.coolest_slot, extremes.hottest_slot) == (1, 0)
    stats = gpu.slot_stats(df).first()
    assert stats.power_0_mean == pytest.approx((1.0 + 0.999 + 0.1) / 3)
    names = spark.createDataFrame([(1, 1, 1)], [f"{gpu.HEAT}_10", f"{gpu.HEAT}_2", f"{gpu.HEAT}_min"])
    assert gpu.gpu_slots(names) == [2, 10]


def test_hot_share(spark):
    df = spark.createDataFrame(
        [(1, 95.0), (1, 90.0), (1, None), (1, 10.0), (0, None)], "gpu_node int, gpu_temp_max_ratio double"
    )
    rows = {r.gpu_node: r.hot_pct for r in hardware.hot_share(df).collect()}
    assert rows[1] == pytest.approx(100 / 3) and rows[0] is None

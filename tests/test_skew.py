"""Hot keys: the plans split them, and the results stay whole."""

from contextlib import contextmanager
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rackline.operators import distribution, ordered, sweep
from rackline.operators.joins import interval_join
from rackline.plans import energy, integration

START = datetime(2024, 1, 1)

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def large_table_settings(spark):
    """Thresholds scaled down so that small data is planned like large data."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def _samples(spark, n):
    """Half of the rows lie on one node within one time bucket."""
    hot = F.col("id") % 2 == 0
    node = F.when(hot, "r10n1").otherwise(F.concat(F.lit("r11n"), F.col("id") % 40))
    minute = F.when(hot, F.col("id") % 300).otherwise(F.col("id") % 20000)
    return spark.range(0, n, 1, 8).select(
        F.col("id").alias("prom_id"),
        node.alias("node"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=minute.cast("int"))).alias(
            "timestamp"
        ),
        F.lit(0).alias("gpu_node"),
        (F.col("id") % 7).cast("double").alias("node_power_usage"),
    )


def _jobs(spark):
    rows = [(1, ["r10n1"], START, START + timedelta(minutes=150), "FAILED"),
            (2, ["r10n1", "r11n1"], START, START + timedelta(minutes=400), "COMPLETED"),
            (3, ["r11n1", "r11n2"], START, START + timedelta(days=9), "TIMEOUT")]
    return spark.createDataFrame(
        rows, "slurm_id int, slurm_nodes array<string>, start_date timestamp_ntz, "
        "end_date timestamp_ntz, state string")


def test_interval_join_splits_a_hot_bucket(spark):
    with large_table_settings(spark):
        joined = interval_join(_samples(spark, 60_000), _jobs(spark))
        rows, plan = _final_plan(joined.select("prom_id", "slurm_id", "node", "timestamp"))
    assert "SortMergeJoin(skew=true)" in plan
    want = 0
    for i in range(60_000):
        hot = i % 2 == 0
        node = "r10n1" if hot else f"r11n{i % 40}"
        minute = i % 300 if hot else i % 20000
        want += (node == "r10n1" and minute <= 150) + (node in ("r10n1", "r11n1") and minute <= 400)
        want += node in ("r11n1", "r11n2") and minute <= 9 * 24 * 60
    assert len(rows) == want


def test_concurrency_splits_a_hot_instant(spark):
    table = spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("slurm_id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("node"),
        F.lit(START).cast("timestamp_ntz").alias("timestamp"),
    )
    with large_table_settings(spark):
        rows, plan = _final_plan(integration.with_concurrency(table))
    assert "SortMergeJoin(skew=true)" in plan
    assert len(rows) == 60_000
    assert all(r.concurrent_job_count == (30_000 if r.node == "hot" else 1) for r in rows)


def test_energy_with_a_third_of_all_rows_at_one_instant(spark):
    copies = spark.range(0, 30_000, 1, 8).select(
        F.col("id").cast("int").alias("prom_id"),
        F.when(F.col("id") % 3 > 0, "r10n1").otherwise("r11n1").alias("node"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(
            secs=F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 900).cast("decimal(18,6)")
        )).alias("timestamp"),
        F.lit(0).alias("gpu_node"),
        F.lit(10.0).alias("node_power_usage"),
    )
    hour = timedelta(hours=1)
    jobs = spark.createDataFrame(
        [(1, "r10n1", START - hour, START - hour, START + hour, "FAILED", 1, 1),
         (2, "r10n1", START, START, START + hour, "FAILED", 1, 1),
         (3, "r11n1", START, START, START + hour, "TIMEOUT", 1, 1)],
        "id int, node string, submit_date timestamp_ntz, start_date timestamp_ntz, "
        "end_date timestamp_ntz, state string, numnodes int, numcores int")
    window = (START - hour, START + hour)
    with large_table_settings(spark):
        rows, plan = _final_plan(
            energy.per_job(energy.observed_job_nodes(copies, jobs, window))
        )
    # What is left to join are sums at the jobs' ends; samples never meet jobs.
    assert "prom_id" not in plan and "CartesianProduct" not in plan
    found = {r.slurm_id: r for r in rows}
    # Two jobs share 20,000 readings of one instant: each reading counts 1/40,000.
    assert found[1].energy == pytest.approx(10.0 / 40_000 * 7200)
    assert found[2].energy == pytest.approx(10.0 / 40_000 * 3600)
    sizes = {i % 900: 0 for i in range(0, 30_000, 3)}
    for i in range(0, 30_000, 3):
        sizes[i % 900] += 1
    mean = sum(10.0 / n * n for n in sizes.values()) / 10_000
    assert found[3].energy == pytest.approx(mean * 3600)


def test_one_hot_series_and_value(spark):
    """A third of all rows share a value, and one series holds most rows."""
    df = spark.range(0, 30_000, 1, 8).select(
        F.col("id"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("node"),
        F.when(F.col("id") % 3 == 0, 1.5).otherwise((F.col("id") * 7919 % 30_011).cast("double"))
        .alias("x"),
    )
    rows = ordered.row_index(df, ["node"], ["id"])
    sizes = rows.groupBy("node").agg(F.max("row_index").alias("top"), F.count("*").alias("n"))
    assert {r.node: (r.top, r.n) for r in sizes.collect()} == {
        "hot": (23_999, 24_000), "cold": (5_999, 6_000)
    }
    spread = ordered.segmented(df, ["node"], ["id"]).where("node = 'hot'")
    largest = spread.groupBy(ordered.SEGMENT).count().agg(F.max("count")).first()[0]
    assert largest <= 12_000
    ecdf = distribution.ecdf(df, "x").where("x = 1.5").first()
    assert ecdf.pdf == pytest.approx(1 / 3)
    median = distribution.quantiles(df, ["x"], [0.5]).first().p50
    assert median == df.selectExpr("percentile(x, 0.5)").first()[0]


def test_a_sweep_with_most_ends_on_one_node_and_a_third_at_one_instant(spark):
    def when(second):
        return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=second.cast("decimal(18,6)"))

    points = spark.range(0, 3000, 1, 4).select(
        F.lit("hot").alias("node"), when(F.col("id") * 10).alias("ts"), F.lit(1.0).alias("v")
    )
    first = F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id") % 30_000)
    jobs = spark.range(0, 30_000, 1, 8).select(
        F.col("id").alias("job"), F.lit("hot").alias("node"), when(first).alias("first"), when(first + 25_000).alias("last")
    )
    with large_table_settings(spark):
        ends = sweep.sums_inside(
            points, jobs, by="node", at="ts", start="first", end="last", held="held",
            values={"points": F.col("v"), "most": F.col("held")}, bucket_seconds=3600,
        )
        sums = ends.groupBy("job").agg(F.sum("points").alias("n"), F.sum("most").alias("held"))
        rows, plan = _final_plan(sums)
    assert "SortMergeJoin(skew=true)" in plan
    starts = [5000 if i % 3 == 0 else i for i in range(30_000)]
    held = [sum(s <= t <= s + 25_000 for s in starts) for t in range(0, 30_000, 10)]
    for r in rows[::97]:
        inside = [t // 10 for t in range(0, 30_000, 10) if starts[r.job] <= t <= starts[r.job] + 25_000]
        assert (r.n, r.held) == (len(inside), sum(held[t] for t in inside))
    assert len(rows) == 30_000

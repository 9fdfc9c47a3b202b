"""Interval join, attachments and the joined table against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rackline.operators.attach import attach, attach_group
from rackline.operators.joins import BUCKET_SECONDS, FACTOR, LEVELS, cover, interval_join, top_level
from rackline.plans import energy, integration, peers

START = datetime(2023, 12, 31, 12)
NODES = ["r10n1", "r10n2", "r11n1", "r28n1"]
STATES = list(energy.STATES)


def _samples(rng, n=250):
    rows = []
    for i in range(n):
        # Half of all samples come from one node, many of them at one instant.
        node = "r10n1" if rng.random() < 0.5 else rng.choice(NODES)
        minute = 600 if rng.random() < 0.2 else rng.randrange(36 * 60)
        ts = START + timedelta(minutes=minute)
        power = None if rng.random() < 0.1 else rng.uniform(50, 250)
        rows.append((i, node, ts, int(node.startswith("r28")), power))
    return rows


def _jobs(rng, n=80):
    rows = []
    for i in range(n):
        start = START + timedelta(minutes=rng.randrange(36 * 60))
        end = start + timedelta(minutes=rng.choice([0, 5, 90, 600, -10]))
        nodes = rng.sample(NODES, rng.randrange(1, 4))
        nodes += nodes[:1]  # a node listed twice must match once
        rows.append((i, nodes, start, end, rng.choice(STATES), len(nodes), rng.choice([2, 16])))
    return rows


SAMPLE = "prom_id int, node string, timestamp timestamp_ntz, gpu_node int, node_power_usage double"
JOB = (
    "slurm_id int, slurm_nodes array<string>, start_date timestamp_ntz, end_date timestamp_ntz, "
    "state string, numnodes int, numcores int"
)


def _pairs(samples, jobs):
    return [
        (s, j) for s in samples for j in jobs if s[1] in j[1] and j[2] <= s[2] <= j[3]
    ]


@pytest.mark.parametrize("bucket", [7, 600, 6 * 3600, 7 * 24 * 3600])
def test_interval_join_equals_theta_join(spark, bucket):
    rng = random.Random(3)
    samples, jobs = _samples(rng), _jobs(rng)
    joined = interval_join(
        spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB),
        bucket_seconds=bucket,
    )
    found = sorted((r.prom_id, r.slurm_id) for r in joined.collect())
    assert found == sorted((s[0], j[0]) for s, j in _pairs(samples, jobs))
    assert not [c for c in joined.columns if c.startswith("_")]


def test_cover_tiles_every_interval(spark):
    rng = random.Random(8)
    ends = [(0, 0), (0, 15), (1, 16), (15, 16), (16, 31), (-40, 300), (-17, -16), (0, 16**4), (5, 16**5 + 3)]
    ends += [(a, a + rng.randrange(2000)) for a in (rng.randrange(-3000, 3000) for _ in range(200))]
    df = spark.createDataFrame(ends, "first long, last long")
    rows = df.select("first", "last", cover(F.col("first"), F.col("last")).alias("c"), top_level(F.col("first"), F.col("last")).alias("top"))
    for r in rows.collect():
        named = [((b + (1 << 39)) >> 40, b - ((b + (1 << 39)) >> 40 << 40)) for b in r.c]
        tiles = sorted((bucket * FACTOR**level, FACTOR**level) for level, bucket in named)
        at = r["first"]
        for start, width in tiles:
            assert start == at
            at += width
        assert at == r["last"] + 1
        assert max(level for level, _ in named) <= r.top
        assert len(tiles) <= 2 * (FACTOR - 1) * LEVELS


def test_year_long_jobs_take_few_buckets_and_short_ones_leave_samples_single(spark):
    """A year is 1,460 buckets of six hours."""
    year = timedelta(days=365, hours=5)
    jobs = [(i, ["r10n1", "r10n2"], START + timedelta(hours=7 * i), START + timedelta(hours=7 * i) + year, "FAILED", 2, 4) for i in range(20)]
    jobs += [(100 + i, ["r11n1"], START, START + timedelta(hours=3 + i % 9), "FAILED", 1, 4) for i in range(20)]
    samples = [(i, ("r10n1", "r11n1", "r28n1")[i % 3], START + timedelta(hours=11 * i), 0, 1.0) for i in range(600)]
    joined = interval_join(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB))
    found = sorted((r.prom_id, r.slurm_id) for r in joined.collect())
    assert found == sorted((s[0], j[0]) for s, j in _pairs(samples, jobs))
    seconds = F.unix_seconds(F.col("start_date").cast("timestamp")), F.unix_seconds(F.col("end_date").cast("timestamp"))
    first, last = (F.floor(x / F.lit(BUCKET_SECONDS)) for x in seconds)
    sizes = spark.createDataFrame(jobs, JOB).select("slurm_id", F.size(cover(first, last)).alias("n")).collect()
    assert max(r.n for r in sizes if r.slurm_id < 100) <= 70 and max(r.n for r in sizes if r.slurm_id >= 100) <= 3


def test_interval_join_without_broadcast(spark):
    rng = random.Random(4)
    samples, jobs = _samples(rng), _jobs(rng)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = interval_join(
            spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB)
        )
        assert joined.count() == len(_pairs(samples, jobs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_keys_and_times_never_match(spark):
    at = START + timedelta(hours=1)
    samples = spark.createDataFrame([(1, None, at, 0, 1.0), (2, "r10n1", None, 0, 1.0)], SAMPLE)
    jobs = spark.createDataFrame(
        [(1, ["r10n1", None], START, at, "FAILED", 1, 1), (2, None, START, at, "FAILED", 1, 1),
         (3, ["r10n1"], None, at, "FAILED", 1, 1)], JOB)
    assert interval_join(samples, jobs).count() == 0


@pytest.fixture(scope="module")
def joined(spark):
    rng = random.Random(5)
    samples, jobs = _samples(rng), _jobs(rng)
    table = interval_join(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB))
    return table, _pairs(samples, jobs)


def _instant_sizes(pairs):
    sizes = {}
    for s, _ in pairs:
        sizes[s[1], s[2]] = sizes.get((s[1], s[2]), 0) + 1
    return sizes


def test_concurrency(joined):
    table, pairs = joined
    sizes = _instant_sizes(pairs)
    rows = integration.with_concurrency(table).collect()
    assert len(rows) == len(pairs)
    assert all(r.concurrent_job_count == sizes[r.node, r.timestamp] for r in rows)


def test_energy_by_definition(joined):
    table, pairs = joined
    sizes = _instant_sizes(pairs)
    shares, jobs = {}, {}
    for s, j in pairs:
        jobs.setdefault(j[0], [j, 0])
        jobs[j[0]][1] = max(jobs[j[0]][1], s[3])
        if s[4] is not None:
            shares.setdefault((j[0], s[1]), []).append(s[4] / sizes[s[1], s[2]])
    want = {}
    for (job, _), values in shares.items():
        j, gpu = jobs[job]
        run = (j[3] - j[2]).total_seconds()
        key = (gpu, j[4])
        want[key] = want.get(key, 0) + sum(values) / len(values) * run
    got = {(r.gpu_node, r.state): r for r in energy.class_state_metrics(energy.job_nodes(table)).collect()}
    for key, value in want.items():
        assert got[key].node_energy == pytest.approx(value)
    for key in got:
        mine = [j for j, gpu in jobs.values() if (gpu, j[4]) == key]
        assert got[key].submissions == len(mine)
        assert got[key].job_runtime_seconds == sum((j[3] - j[2]).total_seconds() for j in mine)


def test_energy_straight_from_samples_and_jobs(spark):
    rng = random.Random(6)
    samples = spark.createDataFrame(_samples(rng), SAMPLE)
    rows = [(j[0], ",".join(j[1]), j[2], *j[2:]) for j in _jobs(rng)]
    jobs = spark.createDataFrame(
        rows, "id int, node string, submit_date timestamp_ntz, start_date timestamp_ntz, "
        "end_date timestamp_ntz, state string, numnodes int, numcores int")
    table = integration.integrate(samples, jobs)
    both = [
        sorted(energy.per_job(summary).collect())
        for summary in (energy.job_nodes(table), energy.observed_job_nodes(samples, jobs))
    ]
    assert len(both[0]) == len(both[1]) > 20
    for a, b in zip(*both, strict=True):
        assert tuple(a)[:4] == tuple(b)[:4]
        assert a.energy == pytest.approx(b.energy)


def test_class_comparison(joined):
    table, pairs = joined
    rows = {r.gpu_node: r for r in energy.class_comparison(energy.job_nodes(table)).collect()}
    for cls, row in rows.items():
        mine = [(s, j) for s, j in pairs if s[3] == cls]
        assert row.node_count == len({s[1] for s, _ in mine})
        assert row.rack_count == len({s[1][:3] for s, _ in mine})
        assert row.job_submissions == len({j[0] for _, j in mine})
    compared = energy.class_comparison(energy.job_nodes(table))
    shares = energy.normalise_columns(compared, energy.COMPARED).collect()
    for c in energy.COMPARED:
        assert sum(r[c] for r in shares) == pytest.approx(1)


def test_state_counts(joined):
    table, pairs = joined
    rows = integration.state_counts(table, STATES).collect()
    sizes = _instant_sizes(pairs)
    assert {(r.node, r.timestamp): r.total_jobs_running for r in rows} == sizes
    assert all(sum(r[s] for s in STATES) == r.total_jobs_running for r in rows)


def test_peers_without_listing_pairs(joined):
    import pandas as pd

    table, _ = joined
    high = peers.high_load_jobs(table, k=0.2)
    rows = [r.asDict() for r in high.collect()]
    assert len(rows) > 50
    frame = pd.DataFrame(rows)
    pairs = frame.merge(frame, on=["gpu_node", "node", "timestamp"], suffixes=("", "_2"))
    pairs = pairs[pairs.slurm_id != pairs.slurm_id_2]

    want = pairs.groupby(["gpu_node", "state", "state_2"]).size().to_dict()
    got = {(r.gpu_node, r.state, r.state_2): r.pairs
           for r in peers.peer_pairs(high, STATES).collect()}
    assert got == want

    keys = ["slurm_id", "gpu_node", "node", "timestamp"]
    flat = pairs[keys].copy()
    for s in STATES:
        flat[s] = (pairs.state == s).astype(int)
        flat[f"{s}_other"] = (pairs.state_2 == s).astype(int)
    grouped = flat.groupby(keys).agg(
        {s: "max" for s in STATES} | {f"{s}_other": "sum" for s in STATES}
    ).reset_index()
    counts = {(r.slurm_id, r.node, r.timestamp): r
              for r in peers.peer_state_counts(high, STATES).collect()}
    assert len(counts) == len(grouped)
    for row in grouped.to_dict("records"):
        mine = counts[row["slurm_id"], row["node"], row["timestamp"].to_pydatetime()]
        for s in STATES:
            assert mine[s] == row[s] and mine[f"{s}_other_jobs"] == row[f"{s}_other"]

    corr = {(r.gpu_node, r.state, r.state_2): r["corr"]
            for r in peers.peer_state_corr(high, STATES).collect()}
    for cls, part in grouped.groupby("gpu_node"):
        for a in STATES:
            for b in STATES:
                x, y = part[a], part[f"{b}_other"]
                if x.nunique() < 2 or y.nunique() < 2:
                    assert corr[cls, a, b] is None
                else:
                    assert corr[cls, a, b] == pytest.approx(x.corr(y))


def test_lower_triangle(spark):
    rows = [(0, a, b, 0.5) for a in STATES for b in STATES]
    df = spark.createDataFrame(rows, "gpu_node int, state string, state_2 string, corr double")
    kept = peers.lower_triangle(df, STATES).collect()
    assert len(kept) == 21
    assert all(STATES.index(r.state) >= STATES.index(r.state_2) for r in kept)


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_attach_leaves_the_broadcast_to_the_byte_threshold(spark, threshold):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10), ("c", 30)], "k string, v int")
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in settings:
        spark.conf.set(name, threshold)
    try:
        out = attach(fact, dim, "k")
        assert {r.id: r.v for r in out.collect()} == {1: 10, 2: None, 3: None}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold != "-1")
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_attach_group_keeps_the_null_group(spark):
    fact = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, k string")
    out = attach_group(fact, fact.groupBy("k").count(), ["k"])
    assert {r.id: r["count"] for r in out.collect()} == {1: 1, 2: 2, 3: 2}
    assert out.columns == ["id", "k", "count"]


def test_coverage_and_window(spark):
    day = datetime(2024, 1, 10)
    jobs = spark.createDataFrame(
        [(1, day, day + timedelta(days=2)), (2, day + timedelta(days=3), day + timedelta(days=9))],
        "id int, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    samples = spark.createDataFrame(
        [(1, day + timedelta(days=2)), (2, day + timedelta(days=8)), (3, day + timedelta(days=9)),
         (4, day + timedelta(days=20))],
        "prom_id int, timestamp timestamp_ntz",
    )
    rows = {r.source: r for r in integration.date_coverage(jobs, samples).collect()}
    assert {k: r.days for k, r in rows.items()} == {"jobs": 10, "samples": 19, "intersection": 8}
    inside_jobs, inside_samples = integration.restrict_to_window(jobs, samples)
    assert [r.id for r in inside_jobs.collect()] == [2]
    assert sorted(r.prom_id for r in inside_samples.collect()) == [1, 2, 3]

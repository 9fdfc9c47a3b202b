"""Node lists, time columns, JSON maps, ratios and guarded statistics."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rackline.functions import jsonmap, nodes, ratios, times


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("r12n[1-3,32]", ["r12n1", "r12n2", "r12n3", "r12n32"]),
        ("r1n[1-2],r2n5", ["r1n1", "r1n2", "r2n5"]),
        ("r1n[1,3-4],r16n2", ["r1n1", "r1n3", "r1n4", "r16n2"]),
        ("r13n1", ["r13n1"]),
        ("r13n1,r13n2,r13n1", ["r13n1", "r13n2"]),
        ("r1n[1-2,\r\n\t4]", ["r1n1", "r1n2", "r1n4"]),
        ("r1n[a-b]", []),
        ("r1n[3-1]", []),
        ("r1n[2,2-3]", ["r1n2", "r1n3"]),
        ("None assigned", ["None assigned"]),
        ("", []),
        (None, []),
    ],
)
def test_expand_nodes(spark, text, expected):
    df = spark.createDataFrame([(text,)], "node string")
    row = df.select(nodes.expand_nodes(F.col("node")).alias("n")).first()
    assert sorted(row.n) == sorted(expected)


def test_simple_grammar_cuts_ranges(spark):
    df = spark.createDataFrame(
        [("r13n[1,2],r14n3",), ("r12n[1-3,32]",), ("None assigned",)], "node string"
    )
    rows = df.select(nodes.expand_nodes_simple(F.col("node")).alias("n")).collect()
    assert [r.n for r in rows] == [["r13n1", "r13n2", "r14n3"], ["r12n1"], ["rn"]]


def test_gpu_class_and_rack(spark):
    df = spark.createDataFrame(
        [(1, "r28n[1-2]"), (2, "r10n1,r38n5"), (3, "r10n1"), (4, None), (5, "None assigned")],
        "id int, node string",
    )
    marked = {r.id: r for r in nodes.mark_ml(df).collect()}
    assert [marked[i].is_ml for i in (1, 2, 3, 4, 5)] == [1, 1, 0, 0, 0]
    assert [r.gpu_node for r in nodes.flag_gpu(df, "node").orderBy("id").collect()] == [1, 1, 0, 0, 0]
    racks = df.select(
        nodes.rack_regex(F.col("node")).alias("a"), nodes.rack_prefix(F.col("node")).alias("b")
    ).collect()
    assert [tuple(r) for r in racks] == [
        ("r28", "r28"), ("r10", "r10"), ("r10", "r10"), (None, None), ("", "Non")
    ]
    assert len(nodes.GPU_NODES) == len(set(nodes.GPU_NODES)) == 56


def _jobs(spark, rows):
    return spark.createDataFrame(
        rows, "id int, submit_date timestamp_ntz, start_date timestamp_ntz, end_date timestamp_ntz"
    )


def test_calendar_matches_python(spark):
    stamps = [
        datetime(2024, 1, 1, 0, 0, 0),
        datetime(2022, 1, 1, 23, 59, 59),
        datetime(2023, 1, 1, 12, 0, 1),
        datetime(2024, 12, 31, 23, 59, 59),
        datetime(2024, 7, 6, 5, 4, 3),
    ]
    df = _jobs(spark, [(i, t, t, t) for i, t in enumerate(stamps)])
    rows = times.calendar_columns(df).orderBy("id").collect()
    for row, t in zip(rows, stamps, strict=True):
        elapsed = (t - datetime(t.year, 1, 1)).total_seconds()
        assert row.submit_day == t.date()
        assert row.submit_hour_of_day == t.hour
        assert row.submit_day_of_week == t.weekday()
        assert row.month_of_year == t.month
        assert row.week_of_year == t.strftime("%U")
        assert row.day_of_year == t.timetuple().tm_yday
        assert row.hour_of_year == int(elapsed / 3600)
        assert row.minute_of_year == int(elapsed / 60)
        assert row.second_of_year == int(elapsed)


def test_durations_and_clock_change(spark):
    t = datetime(2024, 5, 1, 12, 0, 0)
    df = _jobs(spark, [(1, t, t.replace(hour=13), t.replace(hour=12, minute=30))])
    row = df.select(
        times.wait_hours().alias("wait"),
        times.run_hours().alias("run"),
        times.repair_dst(times.run_hours()).alias("repaired"),
        times.run_seconds().alias("seconds"),
    ).first()
    assert (row.wait, row.run, row.repaired, row.seconds) == (1.0, -0.5, 0.5, -1800)


def test_days_over_new_year(spark):
    df = _jobs(
        spark,
        [
            (1, None, datetime(2023, 12, 30, 23), datetime(2024, 1, 2, 1)),
            (2, None, datetime(2024, 1, 2), datetime(2024, 1, 1)),
            (3, None, datetime(2024, 3, 1, 1), datetime(2024, 3, 1, 2)),
        ],
    )
    days = times.explode_days(df, "start_date", "end_date").orderBy("id", "running_day").collect()
    assert [(r.id, str(r.running_day)) for r in days] == [
        (1, "2023-12-30"), (1, "2023-12-31"), (1, "2024-01-01"), (1, "2024-01-02"),
        (3, "2024-03-01"),
    ]


def test_states(spark):
    df = spark.createDataFrame([("CANCELLED by 7",), ("FAILED",), (None,)], "state string")
    rows = df.select(times.normalise_state(F.col("state")).alias("s")).collect()
    assert [r.s for r in rows] == ["CANCELLED", "FAILED", None]


MAPS = [
    (1, '{"0": 1.5, "1": 2.25, "10": 4}'),
    (2, '{"0": 3}'),
    (3, "{}"),
    (4, None),
    (5, "not json"),
    (6, '{"0": "x", "1": 5}'),
]


def test_json_keys_and_columns(spark):
    df = spark.createDataFrame(MAPS, "id int, m string")
    keys = [r.key for r in jsonmap.json_keys(df, "m").collect()]
    assert keys == ["0", "1", "10"]
    wide = {r.id: r for r in jsonmap.json_widen(df, "m", keys).collect()}
    assert [wide[1][f"m-{k}"] for k in ("0", "1", "10")] == [1.5, 2.25, 4.0]
    assert [wide[2][f"m-{k}"] for k in ("0", "1", "10")] == [3.0, None, None]
    assert [wide[6][f"m-{k}"] for k in ("0", "1", "10")] == [None, 5.0, None]
    assert wide[3]["m-0"] is None and wide[4]["m-0"] is None and wide[5]["m-0"] is None


def test_json_entries_as_rows(spark):
    df = spark.createDataFrame(MAPS, "id int, m string")
    rows = {(r.id, r.key): r.value for r in jsonmap.json_long(df, "m").collect()}
    assert rows == {
        (1, "0"): 1.5, (1, "1"): 2.25, (1, "10"): 4.0, (2, "0"): 3.0, (6, "0"): None, (6, "1"): 5.0
    }
    many = "{" + ", ".join(f'"{i}": {i}' for i in range(20_000)) + "}"
    wide = spark.createDataFrame([(1, many)], "id int, m string")
    assert jsonmap.json_long(wide, "m").where("value = double(key)").count() == 20_000


def test_json_statistics(spark):
    df = spark.createDataFrame(MAPS, "id int, m string")
    out = jsonmap.json_aggregate(df, "m", ("min", "mean", "max", "sum"))
    assert out.columns == ["id", "m-min", "m-sum", "m-mean", "m-max"]
    rows = {r.id: tuple(r)[1:] for r in out.collect()}
    assert rows[1] == (1.5, 7.75, 2.58, 4.0)
    assert rows[2] == (3.0, 3.0, 3.0, 3.0)
    for i in (3, 4, 5):
        assert rows[i] == (None, 0.0, None, None)
    single = jsonmap.json_aggregate(df, "m", ("sum",), single_key=True)
    assert {r.id: r["m-sum"] for r in single.collect()}[4] is None
    assert "m-sum" not in jsonmap.json_aggregate(df, "m", ("min", "mean")).columns


def test_ratios_survive_zero_and_clip(spark):
    row = dict(
        gpu_node=0, node_load1=40.0, cpu_core_count_total=16, node_rapl_package_power_sum=50.0,
        cpu_tdp_total=100, node_memory_Active_bytes=5.0, cpu_memory_bytes_total=10,
        nvidia_gpu_power_usage_milliwatts_sum=0.0, gpu_tdp_total=0,
        nvidia_gpu_memory_used_bytes_sum=0.0, gpu_memory_bytes_total=0, node_ambient_temp=30.0,
        cpu_t_case_max=80, cpu_per_core_temp_max=100, gpu_temp_max=30,
    )
    for metric in (
        "node_thermal_zone_temp", "node_hwmon_temp_celsius", "nvidia_gpu_temperature_celsius"
    ):
        row |= {f"{metric}_min": 20.0, f"{metric}_mean": 55.0, f"{metric}_max": 80.0}
    df = spark.createDataFrame([row])
    raw = ratios.utilisation_ratios(df).first()
    assert raw.node_load_1_ratio == 2.5
    assert raw.cpu_temp_min_ratio == -0.2
    assert raw.gpu_power_sum_ratio is None and raw.gpu_temp_max_ratio is None
    clean = ratios.clean_ratios(ratios.utilisation_ratios(df)).first()
    assert clean.node_load_1_ratio == 1.0
    assert clean.cpu_temp_min_ratio == 0.0
    assert clean.cpu_temp_mean_ratio == 0.5
    assert clean.gpu_power_sum_ratio == 0.0


def test_byte_units(spark):
    df = spark.createDataFrame(
        [(int(2.5 * 1024**3), 3 * 1024**4, 7)], "cpu_memory_bytes_total long, "
        "node_filesystem_size_bytes_total long, cpu_count int"
    )
    out = ratios.convert_bytes(df)
    assert out.columns == [
        "cpu_memory_giga_bytes_total", "node_filesystem_size_tera_bytes_total", "cpu_count"
    ]
    assert tuple(out.first()) == (2.0, 3.0, 7)


def test_json_leaves(spark):
    texts = [
        '{"a": {"b": [1, {"c": "x"}, null, []]}, "d": 2.5, "e": {}}',
        "[true, [[7]]]",
        '"alone"',
        "null",
        "{broken",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string").withColumn("path", F.lit("mine"))
    rows = sorted((r.id, r.path, r.value) for r in jsonmap.json_leaves(df, "doc").collect())
    assert rows == sorted([
        (0, "$.a.b[0]", "1"), (0, "$.a.b[1].c", "x"), (0, "$.a.b[2]", None), (0, "$.d", "2.5"),
        (1, "$[0]", "true"), (1, "$[1][0][0]", "7"), (2, "$", "alone"), (3, "$", None),
    ], key=lambda r: r[:2])
    kinds = {r.path: r.kind for r in jsonmap.json_leaves(df.where("id = 0"), "doc").collect()}
    assert kinds["$.a.b[1].c"] == "STRING" and kinds["$.a.b[2]"] == "VOID" and kinds["$.d"].startswith("DECIMAL")
    shallow = {r.path: r.value for r in jsonmap.json_leaves(df.where("id < 2"), "doc", levels=2).collect()}
    assert shallow["$.a.b"] == '[1,{"c":"x"},null,[]]' and shallow["$[1][0]"] == "[7]"

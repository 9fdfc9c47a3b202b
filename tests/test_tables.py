"""Catalog, loader, sink and materialisation."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from rackline.operators.clean import drop_observed, fill_drop
from rackline.plans.integration import with_concurrency
from rackline.sources import tables
from rackline.sources.loader import read_table
from rackline.sources.tables import Tables, intermediate_tables, store_bucketed

START = datetime(2024, 1, 1)


@pytest.fixture
def samples(spark):
    rows = [
        (i, f"r1n{i % 3}", START + timedelta(minutes=i), None if i % 10 == 0 else float(i),
         None if i % 4 == 0 else "{}")
        for i in range(60)
    ]
    return tables.literal_table(
        spark, rows,
        "id long, node string, timestamp timestamp_ntz, nvidia_power double, nvidia_map string",
    )


def test_catalog(spark, samples, tmp_path):
    names = Tables(str(tmp_path))
    for name in Tables.NAMES:
        samples.write.parquet(names.path(name))
    assert names.load(spark, "jobs").count() == 60
    names.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM node_samples JOIN jobs USING (id)").first().n == 60
    assert names.path("node_hardware").endswith("/node_hardware_info.parquet")


def test_materialise_cuts_lineage(spark, samples, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_folder(spark) == shared
    stored = tables.materialise(samples.where("id > 5").repartition(3))
    assert stored.schema == samples.schema
    assert all(shared in f for f in stored.inputFiles())
    assert "Exchange" not in stored._jdf.queryExecution().toString()
    assert sorted(stored.collect()) == sorted(samples.where("id > 5").collect())
    named = tables.materialise(samples, str(tmp_path / "t"))
    assert tables.load(spark, str(tmp_path / "t")).count() == named.count() == 60


def test_write_joined_overwrites_and_clusters(spark, samples, tmp_path):
    path = str(tmp_path / "joined")
    table = samples.selectExpr("*", "timestamp AS start_date")
    tables.write_joined(table, path)
    tables.write_joined(table.where("id < 50"), path)
    back = tables.load(spark, path)
    assert sorted(back.collect()) == sorted(table.where("id < 50").collect())
    spans = back.selectExpr("node", "timestamp", "input_file_name() AS f").collect()
    files = {}
    for r in spans:
        files.setdefault(r.f, []).append((r.node, r.timestamp))
    ranges = sorted((min(v), max(v)) for v in files.values())
    assert len(ranges) > 1
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert all(v == sorted(v) for v in files.values())


def test_loader_options(spark, samples, tmp_path):
    path = str(tmp_path / "t")
    samples.write.parquet(path)
    df, seen = read_table(spark, path)
    assert df.count() == 60
    assert {r.name for r in seen.collect()} == set(df.columns)
    third, _ = read_table(spark, path, nth=3, sort=True)
    ordered = sorted(samples.collect(), key=lambda r: (r.node, r.timestamp))
    assert third.collect() == ordered[::3]
    clean, seen = read_table(spark, path, clean=True)
    assert clean.count() == 60
    assert {r.name: r.null_percentage for r in seen.collect()}["nvidia_map"] == 25.0


def test_columns_by_type_and_name(samples):
    assert tables.select_by_dtype(samples, T.DoubleType).columns == ["nvidia_power"]
    assert tables.columns_with(samples, "nvidia", "map") == ["nvidia_map"]


def test_profile_comes_from_the_pass_that_writes(spark, tmp_path):
    path = f"{tmp_path}/read_once"
    spark.range(100).selectExpr("id", "CASE WHEN id % 4 > 0 THEN id / 2 END AS x", "'n' AS node").write.parquet(path)
    table, seen = read_table(spark, path, clean=True)
    shutil.rmtree(path)  # nothing reads it again
    rows = {r.name: r for r in seen.collect()}
    assert rows["x"].null_percentage == 25 and rows["id"].example_value == "0" and rows["x"]["mean"] == 25.0
    assert table.count() == 75


def test_rows_are_counted_while_the_clean_table_is_written(spark, tmp_path):
    path = f"{tmp_path}/observed"
    spark.range(40).selectExpr("id", "CASE WHEN id % 4 > 0 THEN id END AS x").write.parquet(path)
    table, share = drop_observed(spark.read.parquet(path), fill_drop)
    shutil.rmtree(path)
    assert tuple(share.first()) == (40, 30, 25.0) and table.count() == 30


def test_bucketed_tables_need_no_shuffle_by_their_keys(spark):
    with intermediate_tables(spark):
        rows = spark.range(5000).selectExpr("id % 40 AS node", "id % 7 AS timestamp", "id AS slurm_id")
        stored = store_bucketed(rows, ["node", "timestamp"])
        counted = with_concurrency(stored)
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "")
        assert counted.count() == 5000 and stored.count() == 5000
        assert spark.catalog.listTables() != []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]

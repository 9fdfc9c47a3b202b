"""Distribution operators against pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rackline.operators import correlation, distribution


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    rows = []
    for i in range(600):
        # A third of all rows share one value; one class is much larger.
        x = 0.0 if rng.random() < 0.34 else round(rng.lognormvariate(0, 2), 6)
        y = None if rng.random() < 0.1 else float(rng.randrange(20))
        rows.append((i, rng.choice(["a", "a", "a", "b"]), x, y))
    return pd.DataFrame(rows, columns=["id", "g", "x", "y"])


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [
        (int(r.id), r.g, float(r.x), None if pd.isna(r.y) else float(r.y))
        for r in table.itertuples()
    ]
    return spark.createDataFrame(rows, "id int, g string, x double, y double")


def test_describe(df, table):
    found = {(r.g, r.variable): r for r in distribution.describe(df, ["x", "y"], ["g"]).collect()}
    assert len(found) == 4
    for g, part in table.groupby("g"):
        for c in ("x", "y"):
            want, got = part[c].describe(), found[(g, c)]
            names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
            assert [got[n] for n in names] == pytest.approx(list(want))


def test_describe_single_row_and_scale(spark):
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    row = distribution.describe(df, ["x"], scale=60).first()
    assert (row["count"], row["mean"], row["std"], row["p50"]) == (1, 120.0, None, 120.0)


@pytest.mark.parametrize("qs", [[0.0, 0.0001, 0.3, 0.7415, 0.9072, 0.9999, 1.0]])
def test_quantiles(df, table, qs):
    rows = distribution.quantiles(df, ["x"], qs, ["g"]).collect()
    for r in rows:
        want = table[table.g == r.g].x.quantile(qs)
        assert list(r)[2:] == pytest.approx(list(want))
    assert rows[0].__fields__[2:] == ["p0", "p0_01", "p30", "p74_15", "p90_72", "p99_99", "p100"]


@pytest.mark.parametrize("margin", [1e-9, 0.0005, 1.0])
def test_quantiles_with_ties_and_brackets_that_miss(spark, margin):
    rng = random.Random(2)
    values = [1.0] * 700 + [rng.random() for _ in range(500)] + [9.0] * 3
    df = spark.createDataFrame([(v, 5.0, None) for v in values], "x double, same double, none double")
    qs = [0.0, 0.2, 0.417, 0.5, 0.9985, 1.0]
    found = distribution.quantiles(df, ["x", "same", "none"], qs, margin=margin).collect()
    rows = {r.variable: list(r)[1:] for r in found}
    assert rows["x"] == pytest.approx(list(pd.Series(values).quantile(qs)))
    assert rows["same"] == [5.0] * len(qs)
    assert set(rows) == {"x", "same"}


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "x double, g string")
    assert distribution.quantiles(df, ["x"], [0.5], ["g"]).collect() == []
    assert distribution.winsorize(df, ["x"], ["g"]).collect() == []


def test_ecdf(df, table):
    rows = distribution.ecdf(df, "y", ["g"]).orderBy("g", "y").collect()
    for g, part in table.groupby("g"):
        mine = [r for r in rows if r.g == g]
        share = part.y.dropna().value_counts(normalize=True).sort_index()
        assert [r.y for r in mine] == list(share.index)
        assert [r.pdf for r in mine] == pytest.approx(list(share))
        assert [r.cdf for r in mine] == pytest.approx(list(share.cumsum()))
        assert mine[-1].cdf == 1.0


def test_box(df, table):
    stats = {r.g: r for r in distribution.box_stats(df, ["x"], ["g"]).collect()}
    outliers = distribution.box_outliers(df, ["x"], ["g"]).collect()
    for g, part in table.groupby("g"):
        q1, med, q3 = part.x.quantile([0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = part.x[(part.x >= low) & (part.x <= high)]
        outside = part.x[(part.x < low) | (part.x > high)]
        got = stats[g]
        assert [got.q1, got.median, got.q3] == pytest.approx([q1, med, q3])
        assert (got.whisker_low, got.whisker_high) == (inside.min(), inside.max())
        assert (got.outlier_rows, got.outlier_values) == (len(outside), outside.nunique())
        mine = {r.value: r.n for r in outliers if r.g == g}
        assert mine == outside.value_counts().to_dict()


def test_winsorize(df, table):
    got = {r.id: r.x for r in distribution.winsorize(df, ["x"], ["g"], 0.9).collect()}
    want = table.copy()
    for g, part in table.groupby("g"):
        want.loc[part.index, "x"] = part.x.clip(upper=part.x.quantile(0.9))
    assert [got[i] for i in want.id] == pytest.approx(list(want.x))


def test_winsorize_whole_table(df, table):
    got = {r.id: r.x for r in distribution.winsorize(df, ["x"], q=0.8).collect()}
    want = table.x.clip(upper=table.x.quantile(0.8))
    assert [got[i] for i in table.id] == pytest.approx(list(want))


def test_modes_keep_all_ties(spark):
    df = spark.createDataFrame(
        [("g", 1, "a"), ("g", 1, "b"), ("g", 2, "b"), ("g", 2, None), ("g", 3, "c")],
        "k string, n int, s string",
    )
    rows = distribution.modes(df, ["n", "s"], ["k"]).orderBy("variable", "value").collect()
    assert [(r.variable, r.value, r.n) for r in rows] == [
        ("n", "1", 2), ("n", "2", 2), ("s", "b", 2)
    ]


def test_histogram(spark):
    values = [0.0, 4.4, 4.6, 5.0, 105.0, 110.0, 110.6, -1.0, None, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = {r.bin_left: r for r in distribution.histogram_density(df, ["x"]).collect()}
    assert {k: r.n for k, r in rows.items()} == {0: 3, 5: 2, 105: 2}
    assert rows[5].density == pytest.approx(2 / (7 * 5))
    assert sum(r.density * 5 for r in rows.values()) == pytest.approx(1)


def test_counts_totals_and_shares(df, table):
    totals = {r.variable: r.total for r in distribution.column_totals(df, ["x", "y"]).collect()}
    assert totals == pytest.approx({"x": table.x.sum(), "y": table.y.sum()})
    counts = distribution.value_counts(df, "y", ["g"]).collect()
    assert sum(r.n for r in counts) == table.y.notna().sum()
    assert [r.g for r in distribution.distinct_values(df, "g").collect()] == ["a", "b"]
    assert distribution.count_distinct(df, ["y"]).first().n_y == table.y.nunique()
    share = distribution.shares(df, {"low": F.col("y") <= 3}).first().low
    assert share == pytest.approx((table.y <= 3).mean())


def test_average_ranks(df, table):
    ranks = {r.value: r["rank"] for r in distribution.average_ranks(df, ["x"]).collect()}
    want = table.x.rank()
    assert [ranks[x] for x in table.x] == pytest.approx(list(want))


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation(df, table, method):
    complete = table.dropna().assign(c=1.0)
    frame = df.withColumn("c", F.lit(1.0))
    if method == "pearson":
        found = correlation.pearson_matrix(frame)
    else:
        found = correlation.spearman_matrix(frame, ["x", "y", "c"], ["id"])
    got = {(r.x, r.y): r["corr"] for r in found.collect()}
    want = complete[["x", "y"]].corr(method)
    assert len(got) == 9
    for a in ("x", "y"):
        assert got[(a, "c")] is None
        for b in ("x", "y"):
            assert got[(a, b)] == pytest.approx(want.loc[a, b])


def test_correlation_without_doubles(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert correlation.pearson_matrix(df).count() == 0


@pytest.mark.parametrize("block", [4, 1, 2])
def test_correlation_in_blocks_of_columns(spark, monkeypatch, block):
    monkeypatch.setattr(correlation, "BLOCK", block)
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0), (4.0, None, 5.0), (float("nan"), 9.0, 5.0)],
        "x double, y double, c double",
    )
    found = {(r.x, r.y): r.corr for r in correlation.pearson_matrix(df).collect()}
    assert found["x", "y"] == found["y", "x"] == pytest.approx(0.9332565252573828)
    assert found["x", "x"] == pytest.approx(1.0)
    assert found["x", "c"] is None and found["c", "c"] is None and len(found) == 9
    nothing = correlation.pearson_matrix(df.limit(0)).collect()
    assert len(nothing) == 9 and all(r.corr is None for r in nothing)


def test_one_plan_for_many_columns(spark):
    rng = random.Random(4)
    rows = [tuple(rng.gauss(0, 1) + (i % 7) * c for c in range(21)) for i in range(400)]
    names = [f"c.{c}" for c in range(21)]
    frame = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).withColumn("id", F.monotonically_increasing_id())
    want = {"pearson": pd.DataFrame(rows, columns=names).corr(), "spearman": pd.DataFrame(rows, columns=names).corr("spearman")}
    pearson = correlation.pearson_matrix(frame, names)
    found = {"pearson": pearson, "spearman": correlation.spearman_matrix(frame, names, ["id"])}
    for method, df in found.items():
        got = {(r.x, r.y): r["corr"] for r in df.collect()}
        assert len(got) == 21 * 21
        assert all(got[a, b] == pytest.approx(want[method].loc[a, b]) for a in names for b in names)


def test_row_ranks_of_a_value_over_many_segments(spark):
    """Half of the rows share a value; another tie ends where a segment does."""
    values = [5.0] * 500 + [float(i // 3) for i in range(300)] + [1000.0 + i for i in range(200)]
    rows = [(i, [v, -v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(6)
    got = {(r.id, r.variable): r["rank"] for r in correlation.row_ranks(df, ["id"]).collect()}
    for variable, sign in ((0, 1), (1, -1)):
        want = (sign * pd.Series(values)).rank()
        assert [got[i, variable] for i in range(1000)] == list(want)


def test_ranks_move_before_they_are_put_into_lists(spark):
    from rackline.sources import tables

    frame = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(50)], "id int, x double, y double")
    plans = []
    tables.written.append(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()))
    try:
        assert correlation.spearman_matrix(frame, ["x", "y"], ["id"]).count() == 4
    finally:
        tables.written.clear()
    (plan,) = [p for p in plans if "partial_collect_list" in p]
    between = plan[: plan.index("partial_collect_list")]
    assert "Exchange" not in between[between.index("functions=[collect_list") :]

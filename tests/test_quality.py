"""Profiles and cleaning on literal tables."""

import pytest

from rackline.operators import clean, profile

SCHEMA = "id int, node string, x double, nvidia_p double, nvidia_m string, s string"
ROWS = [
    (1, "a", 1.0, None, None, "u"),
    (2, "a", None, 2.0, "{1}", None),
    (3, "b", float("nan"), 3.0, "{2}", "w"),
    (4, "b", 5.0, 4.0, "{3}", "v"),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_null_shares(df):
    assert tuple(profile.null_pct(df).first()) == (0.0, 0.0, 25.0, 25.0, 25.0, 25.0)
    rows = {r.node: r for r in profile.null_pct_by(df).collect()}
    assert rows["a"]["x%null"] == 50.0 and rows["b"]["x%null"] == 0.0
    assert rows["a"]["node%null"] == 0.0
    assert rows["a"]["cols_mean%null"] == 33.333


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b"), (2, 2.0, None), (3, None, "a"), (4, 4.0, "c")], "n int, x double, s string"
    )
    rows = {r.name: r for r in profile.profile(df).collect()}
    assert [r for r in rows] == ["n", "x", "s"]
    x = rows["x"]
    assert (x.dataType, x.null_percentage, x.example_value) == ("double", 25.0, "1.0")
    assert (x.mean, x.std, x.coeff_var) == (2.33, 1.53, 0.6567)
    assert (rows["s"].example_value, rows["s"].mean, rows["s"].null_percentage) == ("a", None, 25.0)
    assert (rows["n"].dataType, rows["n"].coeff_var) == ("int", None)


def test_complete_rows_and_mask(df):
    assert tuple(profile.complete_rows(df).first()) == (4, 2)
    mask = profile.null_mask(df, ["id"]).orderBy("id").collect()
    assert tuple(mask[0]) == (1, False, False, True, True, False)


def test_overview(spark):
    df = spark.createDataFrame([(1, 5), (3, 9)], "a int, b int")
    assert tuple(profile.overview(df, "t", "a", "b").first()) == ("t", 2, 2, 1, 9)


def test_fill_drop(df):
    kept = clean.fill_drop(df).orderBy("id").collect()
    assert [r.id for r in kept] == [1, 4]
    assert (kept[0].nvidia_p, kept[0].nvidia_m) == (0.0, "{}")
    assert [r.id for r in clean.fill_drop(df, also=["x", "s"]).orderBy("id").collect()] == [1, 2, 3, 4]
    filled = {r.id: r for r in clean.fill_drop_all(df).collect()}
    assert len(filled) == 4 and filled[2].x == 0.0 and filled[2].s == "{}"


def test_nan_is_not_complete_after_drop(df):
    # dropna removes NaN as well as null, as it does for the analyses.
    assert 3 not in [r.id for r in clean.fill_drop(df).collect()]


def test_dropped_pct(df):
    row = clean.dropped_pct(df, clean.fill_drop(df)).first()
    assert tuple(row) == (4, 2, 50.0)
    empty = df.where("id > 9")
    assert clean.dropped_pct(empty, empty).first().dropped_pct is None

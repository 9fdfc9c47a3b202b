"""Order-dependent operators against plain Python over whole series.

The data has one long series (about half of all rows) that spans several range
partitions, short ones, and one whose key is null.
"""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rackline.operators import ordered


def _rows(seed, n=400, missing=0.4):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["b", "c", "d", None]
    rows = []
    for i in range(n):
        y = None if rng.random() < missing else round(rng.uniform(0, 100), 3)
        if y is not None and rng.random() < 0.05:
            y = float("nan")
        rows.append((i, rng.choice(keys), rng.randrange(n // 4), y, rng.uniform(0, 1)))
    rows += [(n + i, "empty", i, None, 0.5) for i in range(5)]
    rng.shuffle(rows)
    return rows


SCHEMA = "id int, node string, t int, y double, z double"


def _series(rows):
    series = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        series[row[1]].append(row)
    return series


def test_long_series_spans_segments(spark):
    df = spark.createDataFrame(_rows(1), SCHEMA)
    hot = ordered.segmented(df, ["node"], ["t", "id"]).where("node = 'hot'")
    assert hot.select(ordered.SEGMENT).distinct().count() > 1


def _missing(y):
    return y is None or y != y


def _interpolated(values, default, epsilon):
    out = []
    known = [i for i, y in enumerate(values) if not _missing(y)]
    for i, y in enumerate(values):
        if not _missing(y):
            out.append(y)
            continue
        before = [k for k in known if k < i]
        after = [k for k in known if k > i]
        if before and after:
            j, k = before[-1], after[0]
            base = values[j] + (i - j) * (values[k] - values[j]) / (k - j)
        elif after:
            base = values[after[0]]
        elif before:
            base = values[before[-1]]
        else:
            base = default
        out.append(base + epsilon)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("missing", "key"), [(0.4, []), (0.97, []), (0.4, ["id"])])
def test_interpolate_random(spark, seed, missing, key):
    rows = _rows(seed, missing=missing)
    df = spark.createDataFrame(rows, SCHEMA)
    out = ordered.interpolate(
        df, ["y"], ["node"], ["t", "id"], {"y": 7.0, "default": 3.0}, 0.25, key
    )
    assert out.columns == [*df.columns, "node_index"]
    found = {r.id: (r.y, r.node_index) for r in out.collect()}
    assert len(found) == len(rows)
    for series in _series(rows).values():
        expected = _interpolated([r[3] for r in series], 7.0, 0.25)
        for i, (row, y) in enumerate(zip(series, expected, strict=True)):
            assert found[row[0]][1] == i
            assert found[row[0]][0] == pytest.approx(y)


def test_interpolate_golden(spark):
    a = [None, 30, None, None, None, 30, 40, 45, 50, None]
    b = [45, 50, None, 80, 85]
    rows = [(i, "A", i, y) for i, y in enumerate(a, 1)]
    rows += [(i, "B", i, y) for i, y in enumerate(b, 11)]
    df = spark.createDataFrame(
        [(i, n, t, None if y is None else float(y)) for i, n, t, y in rows],
        "id int, node string, timestamp int, node_power_usage double",
    )
    out = ordered.interpolate(df, ["node_power_usage"]).orderBy("id").collect()
    assert [r.node_power_usage for r in out] == [
        30, 30, 30, 30, 30, 30, 40, 45, 50, 50, 45, 50, 65, 80, 85
    ]
    near = ordered.null_rows_with_neighbours(df).orderBy("id").collect()
    assert [r.id for r in near] == [1, 2, 3, 4, 5, 6, 9, 10, 12, 13, 14]
    assert [r.id for r in near if r.has_null] == [1, 3, 4, 5, 10, 13]


def test_all_missing_takes_default(spark):
    df = spark.createDataFrame([(1, "n", 1, None), (2, "n", 2, None)],
                               "id int, node string, t int, y double")
    for defaults, expected in (({"y": 4.0}, 4.5), ({"default": 2.0}, 2.5), (None, 0.5)):
        out = ordered.interpolate(df, ["y"], ["node"], ["t"], defaults, 0.5).collect()
        assert [r.y for r in out] == [expected, expected]


@pytest.mark.parametrize("seed", [4, 5])
def test_neighbours_random(spark, seed):
    rows = [(r[0], r[1] or "null", *r[2:]) for r in _rows(seed, missing=0.05)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = ["id"] if seed == 5 else []
    near = ordered.null_rows_with_neighbours(df, ["node"], ["t", "id"], key=key)
    assert near.columns == [*df.columns, "has_null"]
    found = {r.id: r.has_null for r in near.collect()}
    expected = {}
    for series in _series(rows).values():
        gaps = [r[3] is None for r in series]
        for i, row in enumerate(series):
            if any(gaps[max(0, i - 1): i + 2]):
                expected[row[0]] = gaps[i]
    assert found == expected


@pytest.mark.parametrize("by", [[], ["node"]])
def test_every_nth_and_row_index(spark, by):
    rows = _rows(6)
    df = spark.createDataFrame(rows, SCHEMA)
    series = _series(rows) if by else {"all": sorted(rows, key=lambda r: (r[2], r[0]))}
    index = {r[0]: i for s in series.values() for i, r in enumerate(s)}
    got = {r.id: r.row_index for r in ordered.row_index(df, by, ["t", "id"]).collect()}
    assert got == index
    for key in ([], ["id"]):
        sample = ordered.every_nth(df, 7, ["t", "id"], by, key)
        assert sample.columns == df.columns
        assert {r.id for r in sample.collect()} == {i for i, x in index.items() if x % 7 == 0}


def test_running_total_with_series_totals(spark):
    rows = _rows(7)
    df = spark.createDataFrame(rows, SCHEMA).drop("y")
    out = ordered.running_total(
        ordered.segmented(df, ["node"], ["t", "id"]), ["node"], ["t", "id"], "t", "cum",
        {"total": (F.sum, F.col("t")), "top": (F.max, F.col("z")), "low": (F.min, F.col("z"))},
    )
    found = {r.id: r for r in out.collect()}
    for series in _series(rows).values():
        total = 0
        for row in series:
            total += row[2]
            r = found[row[0]]
            assert r.cum == total
            assert r.total == sum(x[2] for x in series)
            assert r.top == max(x[4] for x in series) and r.low == min(x[4] for x in series)

import random

import numpy as np
import pytest

from rackline.llm import bond

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, positives=5, negatives=5, share=80):
    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(
            x is not None and np.isfinite(np.float32(x)) for x in r[1]
        )

    def whole(v):
        return [int(np.floor(256 * float(np.float32(x)))) for x in v]

    rows = [(i, whole(v), g) for i, v, g in filter(usable, rows)]
    out = []
    for a, own, label in sorted((i, whole(v), g) for i, v, g in filter(usable, anchors)):
        scored = [(-sum(x * y for x, y in zip(own, v, strict=False)), i, g) for i, v, g in rows]
        near = sorted((s, i) for s, i, g in scored if g == label and i != a)[:positives]
        for s, i in near:
            fit = sorted((n, j) for n, j, g in scored if g != label and share * -s <= 100 * -n <= 100 * -s)
            out += [(a, i, rank + 1, j, -s, -n) for rank, (n, j) in enumerate(fit[:negatives])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("width", "labels", "step"), [(16, 4, 8), (5, 2, 1), (64, 10, 8), (3, 1, 2)])
def test_equals_brute_force(spark, monkeypatch, width, labels, step):
    monkeypatch.setattr(bond, "STEP", step)
    rng = random.Random(width)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 6]], rng.randrange(labels)) for i in range(260)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = bond.hard_negatives(df, df.where("vec_id % 20 = 0"))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert got(found) == want
    assert bool(want) == (labels > 1)
    assert got(bond.hard_negatives(df, df.where("vec_id % 20 = 0"), block_bytes=100)) == want


def test_bounds_drop_candidates_before_all_dimensions_are_read():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(4000, 64)) * np.linspace(2, 0.1, 64))
    columns, looks = bond.Columns(rows), []

    def useful(low, high, _):
        looks.append(len(low))
        return high >= np.partition(low, len(low) - 5)[len(low) - 5]

    place, score = columns.scan(rows[0], np.arange(1, 4000), useful)
    assert looks[0] == 3999 and looks[-1] < 400
    exact = rows[1:] @ rows[0]
    assert set(np.argsort(-exact)[:5] + 1) <= set(place)
    assert (score == (rows[place] @ rows[0]).astype(int)).all()


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 1.0], 0),
        (1, [1.0, 1.0], 0),
        (1, [1.0, 1.0], 0),
        (2, [0.9, 1.0], 1),
        (2, [0.9, 1.0], 1),
        (3, [1.0, 1.0], None),
        (4, None, 1),
        (5, [float("nan"), 1.0], 1),
        (6, [1.0, None], 1),
        (None, [1.0, 1.0], 1),
        (7, [1.0], 1),
        (8, [-1.0, -1.0], 0),
        (9, [], 0),
        (10, [0.0, 0.0], 1),
        (11, [1.0, 0.9, 5.0], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS score", "2 AS rank", "3 AS a")
    anchors = [r for r in rows if r[0] == 0]
    want = brute(rows, anchors)
    assert got(bond.hard_negatives(df, df.where("vec_id = 0"))) == want
    assert {w[1] for w in want} == {1, 9} and {w[3] for w in want} == {2, 10, 11}
    assert bond.hard_negatives(df.limit(0), df).count() == 0
    assert bond.hard_negatives(df, df.limit(0)).count() == 0

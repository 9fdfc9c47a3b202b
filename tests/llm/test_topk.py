import random

import numpy as np
import pytest

from rackline.llm import topk, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k, scale=1024):
    """By hand, in whole numbers."""

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)

    def whole(v):
        return [int(np.floor(scale * float(np.float32(x)))) for x in v]

    rows = [(i, whole(v)) for i, v, *_ in rows if i is not None and usable(v)]
    out = []
    for q in sorted({i for i, v, *_ in queries if i is not None and usable(v)}):
        own = max([list(map(np.float32, v)) for i, v, *_ in queries if i == q and usable(v)])
        own = whole(own)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def table(rng, count, width, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(width)], i % 3) for i in range(count)]


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("lists", "k", "width"), [(1, 3, 8), (2, 10, 16), (3, 1, 7), (4, 5, 3), (2, 500, 6)])
def test_equals_brute_force(spark, monkeypatch, lists, k, width):
    monkeypatch.setattr(topk, "HEAD", 4)
    monkeypatch.setattr(topk, "TILE", 512)
    rows = table(random.Random(lists), 300, width)
    rows += [(1000 + i, rows[7][1], 0) for i in range(40)]  # copies: ties
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), k, lists)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert got(found) == brute(rows, [r for r in rows if r[0] % 50 == 0], k)


def test_blocks_of_queries_give_the_same(spark):
    rows = table(random.Random(5), 200, 4)
    df = spark.createDataFrame(rows, VECTORS)
    asked = df.where("vec_id % 10 = 0")
    assert got(topk.top_k(df, asked, 3, block_bytes=200)) == got(topk.top_k(df, asked, 3))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -2.0], 0),
        (0, [1.0, 3.0], 0),  # the query is the larger of the two
        (1, None, 0),
        (2, [1.0, None], 0),
        (3, [nan, 1.0], 0),
        (4, [inf, 1.0], 0),
        (None, [5.0, 5.0], 0),
        (5, [], 0),
        (6, [2.0], None),
        (7, [2.0, 0.5, 9.0], None),
        (8, [-1.0, -1.0], 1),
        (8, [-1.0, -1.0], 1),
        (9, [0.0009, -0.0009], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS score", "2 AS qs", "3 AS q")
    want = brute(rows, rows, 4)
    assert got(topk.top_k(df, df, 4)) == want
    assert [w[2] for w in want if w[0] == 0] == [7, 6, 5, 9]  # -1 step for -0.0009
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_large_components_are_exact_or_an_error(spark):
    rows = [(0, [3e4 + 0.5, 1.0], 0), (1, [3e4, 2.0], 0), (2, [-3e4, 7.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    assert got(topk.top_k(df, df, 2)) == brute(rows, rows, 2)
    a = np.full((1, 2), 2.0**40)
    with pytest.raises(OverflowError):
        vectors.exact(a, a)
    b = np.full((1, 2), 2.0**28 + 1)
    one, two = vectors.exact(b, b)
    assert int((one @ two.T)[0, 0]) == 2 * (2**28 + 1) ** 2

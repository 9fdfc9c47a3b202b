import random
from collections import defaultdict
from functools import reduce

import pytest
from fixtures import DOCS, empty, odd
from pyspark.sql import functions as F

from rackline.llm import mixing
from rackline.llm.storage import Workspace


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, limit=2.0):
    """Deal by weight, stop at the limit, deal the rest again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= limit * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, None: 50, "d": 3, "e": 700}, {"a": 5}, {"a": 0, "b": 7}, {"z": 10, "Z": 500, "ä": 20, "": 4}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def many(spark, n=3000):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), "en", ("hot", "b", "c")[0 if i % 3 else 1 + i % 2], 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_sums_come_near_their_targets_and_reruns_agree(spark):
    docs = many(spark)
    rows = mixing.mix(docs).collect()
    taken, largest, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(r.text.split()) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    assert len(rows) == 3000
    for s in taken:
        assert abs(taken[s] - target[s]) <= min(largest[s], 0.005 * target[s])
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    other = mixing.mix(docs, seed=9).collect()
    assert {(r.doc_id, r.taken) for r in rows} != {(r.doc_id, r.taken) for r in other}


def plain_fold(items):
    """The same draws, one pair after the other: (key, copy) of the decided, and the undecided one."""
    done, rest = [], None
    for size, key, chance, luck in sorted(items, reverse=True):
        if rest is None:
            rest = [size, key, chance]
            continue
        up = min((1 - rest[2]) * rest[0], chance * size)
        down = min(rest[2] * rest[0], (1 - chance) * size)
        words = up if luck * (up + down) < down else -down
        pair = [[rest[0], rest[1], rest[2] + words / rest[0]], [size, key, chance - words / size]]
        done += [(k, c > 0.5) for _, k, c in pair if c <= 1e-9 or c >= 1 - 1e-9]
        rest = next((x for x in pair if 1e-9 < x[2] < 1 - 1e-9), None)
    return done, rest


def test_a_bucket_is_folded_as_by_hand(spark):
    rng = random.Random(3)
    buckets = [
        [(float(rng.randrange(1, 90)), 100 * b + i, rng.choice([0.25, 0.5, rng.random()]), rng.random()) for i in range(n)]
        for b, n in enumerate([0, 1, 2, 3, 17, 64])
    ]
    rows = spark.createDataFrame(
        list(enumerate(buckets)), "b int, items array<struct<size:double,key:long,chance:double,luck:double>>"
    )
    folded = rows.select("b", mixing._fold(F.sort_array("items", asc=False)).alias("f")).collect()
    for r in folded:
        done, rest = plain_fold(buckets[r.b])
        assert [tuple(d) for d in r.f.done] == done
        assert (r.f.rest and [r.f.rest["size"], r.f.rest.key, pytest.approx(r.f.rest.chance)]) == rest


def test_chances_are_kept_on_average(spark):
    items = spark.range(40).select(
        F.lit("s").alias("source"), F.col("id").alias("key"), (1 + F.col("id") % 5).alias("size"), F.lit(0.3).alias("chance")
    )
    runs = [
        mixing.pivotal_round(items, seed, Workspace(spark, f"t{seed}"), bucket=8).withColumn("seed", F.lit(seed))
        for seed in range(12)
    ]
    rows = reduce(lambda a, b: a.unionByName(b), runs).collect()
    assert len(rows) == 12 * 40  # every item is decided once
    words = defaultdict(int)
    for r in rows:
        words[r.seed] += (1 + r.key % 5) * r.copy
    assert all(abs(w - 0.3 * 120) <= 5 for w in words.values())
    assert 0.15 < sum(r.copy for r in rows) / len(rows) < 0.45


def test_odd_rows_empty_table_and_clashing_columns(spark):
    rows = mixing.mix(odd(spark).withColumn("target", F.lit("mine")).withColumn("more", F.lit(1))).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0)
    assert len({r.taken for r in rows if r.doc_id == 6}) == 1
    assert {r.more for r in rows} == {1}
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0)], DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)]

import random

import numpy as np
import pytest
import xxhash
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm import simhash
from rackline.llm.graph import components
from rackline.llm.storage import Workspace


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest id reachable, for {id: fingerprint}."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a b c", "É A b c D", *(" ".join(rng.choice("abcd") for _ in range(n)) for n in range(3, 60))]
    for text in texts:
        assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_CHUNK", 5)
    assert [simhash.fingerprint(t) for t in texts] == whole


@pytest.mark.parametrize("agree", [1, 2, 3, 4])
def test_near_pairs_share_a_block(agree):
    rng = random.Random(agree)
    masks = simhash.block_masks(4, agree)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        shared = [m for m in masks if (a ^ b) & m == 0]
        assert shared
        for m in shared:
            assert any((a ^ b) & r == 0 for r in simhash._rest_masks(m, 4))


def cluster_prints(rng, count):
    """Dense groups, chains, and single ones."""
    out = []
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(count):
            x = centre
            for bit in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << bit
            out.append(x)
        for _ in range(12):  # a chain that leaves the group
            for bit in rng.sample(range(64), 4):
                centre ^= 1 << bit
            out.append(centre)
    return [*out, *(rng.getrandbits(64) for _ in range(50))]


@pytest.mark.parametrize("tile", [4096, 3])
def test_groups_equal_brute_force_also_with_cut_blocks(spark, tile):
    prints = list(dict.fromkeys(cluster_prints(random.Random(5), 25)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    work = Workspace(spark, "t")
    links = work.save(simhash.linked_fingerprints(table, work, tile=tile), "links")
    roots = {r.node: r.root for r in components(links, work).collect()}
    want = brute_groups(dict(zip(signed, prints, strict=True)))
    assert {x: roots.get(x, x) for x in signed} == want
    assert links.count() <= 15 * 6 * len(prints) if tile > 100 else True


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(40)] + [(5, 5)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(table, Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
    assert components(table.limit(0), Workspace(spark, "t")).count() == 0


def test_documents_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(400)] for _ in range(6)]
    texts = [None, "", "same", "same"]
    for words in base:
        for k in range(6):
            own = list(words)
            for i in range(k):
                own[rng.randrange(len(own))] = f"changed{i}"
            texts.append(" ".join(own))
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    want = brute_groups({i: brute_print(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in rows} == want
    assert len(rows) == len(texts)
    kept = simhash.keep_one(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_odd_rows_empty_table_and_clashing_columns(spark):
    table = odd(spark).withColumn("fp", F.lit("x")).withColumn("root", F.lit(0)).withColumn("th", F.lit(0))
    rows = simhash.near_duplicates(table).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}  # all without a word
    kept = simhash.keep_one(table).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "5", "6", "8", "9", "None"])
    assert all(r.fp == "x" for r in kept)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0

import math
import random
import re

import numpy as np
import pytest
from fixtures import DOCS, LONG, empty, odd

from rackline.llm import lexical
from rackline.llm.treap import K2Treap, best_columns

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    texts = [(i, terms(t)) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    out = []
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, own in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in texts) + 1))) for t in own}
        scored = []
        for i, words in texts:
            m = 50 + (50 * len(words) * n) // total
            score = sum(weight[t] * ((10**9 * words.count(t)) // (1000 * words.count(t) + 20 * m)) for t in own if t in words)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_treap_holds_every_maximum():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 70 * 41, 600))
    rows, columns, weight = cells // 41, cells % 41, rng.integers(1, 10**6, len(cells))
    treap = K2Treap(rows, columns, weight)
    grid = np.zeros((128, 128), int)
    grid[rows, columns] = weight
    node = np.zeros((1, 1), np.int64)
    for level in range(treap.height + 1):  # all nodes of a level, as a square
        size = 128 >> level
        most = grid.reshape(128 // size, size, 128 // size, size).max(axis=(1, 3))
        assert (treap.weight(node) == most).all()
        if level < treap.height:
            half = [treap.child(node, np.full_like(node, q)) for q in range(4)]
            node = np.stack([np.stack(half[:2], -1), np.stack(half[2:], -1)], 1).reshape(2 * len(node), -1)


@pytest.mark.parametrize("batch", [1, 3, 256])
def test_descent_finds_the_best_columns(batch):
    rng = np.random.default_rng(batch)
    grid = rng.integers(0, 5, (30, 200)) * (rng.random((30, 200)) < 0.3)
    rows, columns = np.nonzero(grid)
    treap = K2Treap(rows, columns, grid[rows, columns])
    for k in (1, 7, 500):
        own, factor = np.array([0, 3, 4, 29]), np.array([5, 1, 0, 7])
        scores = factor @ grid[own]
        column, score = best_columns(treap, own, factor, k, batch=batch)
        assert (score == scores[column]).all() and len(set(column)) == len(column)
        least = max(1, sorted(scores)[-min(k, 200)])
        assert set(np.flatnonzero(scores >= least)) == set(column)


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    whole = lexical.term_counts(LONG.encode())
    monkeypatch.setattr(lexical, "_PIECE", 7)
    assert lexical.term_counts(LONG.encode()) == whole
    assert whole.total() == 30_000 and not lexical.term_counts(None) and not lexical.term_counts(b" \n.,")


@pytest.mark.parametrize("shard", [1, 3000, 8 << 20])
def test_equals_brute_force(spark, shard):
    rng = random.Random(shard)
    words = [f"w{i}" if i % 5 else f"É{i}x" for i in range(60)]

    def prose(n):
        return " ".join(rng.choice(words[: rng.choice([5, 60])]) + rng.choice(["", ",", ".X", "-"]) for _ in range(n))

    docs = [(i, prose(rng.choice([1, 5, 40, 200]))) for i in range(150)] + [(500 + i, "W1 w2 tie") for i in range(70)]
    items = [(i, prose(12)) for i in range(8)] + [(20, "tie"), (21, "unseen words only"), (22, None), (20, "w7")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(lexical.search(table, asked, shard_bytes=shard)) == want
    if shard > 1:
        assert got(lexical.search(table, asked, item_bytes=60)) == want


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).selectExpr("*", "1 AS score", "2 AS item", "3 AS rank")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "line one without id"), (None, "ünï X word1x1"), (3, ""), (4, None), (4, "ONE")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = got(lexical.search(docs, asked))
    assert found == brute(pairs, items)
    assert any(f[2] is None for f in found) and any(f[0] is None for f in found)
    assert lexical.search(empty(spark), asked).count() == 0
    assert lexical.search(docs, asked.limit(0)).count() == 0
    assert lexical.search(docs, asked.where("text = ''")).count() == 0

import random

import numpy as np
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm import decontaminate as d
from rackline.llm.fmindex import FMIndex, Wavelet, suffix_array

ITEMS = "item_id long, text string"


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = rng.integers(1, 5, rng.integers(1, 120))
        index = FMIndex(text, 6, sample=4)
        patterns = rng.integers(1, 6, (20, 3))
        low, high = index.search(patterns)
        owner, place = index.locate(low, high)
        want = {(p, i) for p in range(20) for i in range(len(text) - 2) if (text[i : i + 3] == patterns[p]).all()}
        assert set(zip(owner.tolist(), place.tolist(), strict=True)) == want
        assert (high - low).clip(0).sum() == len(want)


def test_suffix_array_and_wavelet_rank():
    rng = np.random.default_rng(1)
    text = np.concatenate((rng.integers(1, 9, 200), [0]))
    assert suffix_array(text).tolist() == sorted(range(201), key=lambda i: text[i:].tolist())
    tree = Wavelet(text, 9)
    at = rng.integers(0, 202, 100)
    for c in range(9):
        assert tree.rank(np.full(100, c), at).tolist() == [(text[:i] == c).sum() for i in at]
    assert tree.get(np.arange(201)).tolist() == text.tolist()


def brute(text, items):
    words = d.plain(text).split()
    spans, found = set(), set()
    for item, item_text in items:
        own = d.plain(item_text).split()
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                spans.update(range(i, i + n))
                found.add(item)
    return len(words), len(spans), sorted(found)


def check(spark, table, items):
    rows = d.decontaminate(table, spark.createDataFrame(items, ITEMS), clean=False).collect()
    for r in rows:
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == brute(r.text, items)
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("a", "B", "c.", "x")) for _ in range(rng.randrange(80))) for _ in range(60)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(16)))) for i in range(12)] + [(2, "a b c"), (99, None), (98, "?!")]
    check(spark, docs(spark, texts), items)
    check(spark, odd(spark), [*items, (100, "row without an id"), (101, "ünï çödé " * 5)])


def test_parts_of_the_benchmark_and_small_shards_change_nothing(spark, monkeypatch):
    items = [(i, f"w{i} " + "a b c d e f g h i j k l") for i in range(6)]
    table = docs(spark, ["x a b c d e f g h i j k", "w3 a b c d e f g h i", "nothing"])
    whole = [tuple(r) for r in d.decontaminate(table, spark.createDataFrame(items, ITEMS)).orderBy("doc_id").collect()]
    monkeypatch.setattr(d, "BENCHMARK_BYTES", 20)
    monkeypatch.setattr(d, "SHARD_WORDS", 3)
    parts = [tuple(r) for r in d.decontaminate(table, spark.createDataFrame(items, ITEMS)).orderBy("doc_id").collect()]
    assert whole == parts


def test_spans_are_cut_out_and_clean_texts_stay(spark):
    passage = "Alpha, beta; gamma delta epsilon zeta eta theta iota KAPPA"
    table = docs(spark, [f"É vor: {passage}! nach ü", "clean — text\n ", passage])
    rows = d.decontaminate(table, spark.createDataFrame([(1, passage)], ITEMS)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["É vor: ! nach ü", "clean — text\n ", ""]


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], ITEMS)
    assert d.decontaminate(empty(spark), none).count() == 0
    table = odd(spark).withColumn("spans", F.lit(1)).withColumn("more", F.lit("m"))
    rows = d.decontaminate(table, none).collect()
    assert len(rows) == 10 and all(r.spans == [] and r["items"] == [] and r.more == "m" for r in rows)
    unnamed = d.decontaminate(docs(spark, ["a b c"]), spark.createDataFrame([(None, "b c")], ITEMS)).first()
    assert unnamed["items"] == [] and unnamed.text == "a "

import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm import tokencounts as tc

HOW = tc.Tokenizer(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, "v1")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(HOW.path, "rb"))}
    return tiktoken.Encoding("t", pat_str=HOW.pattern, mergeable_ranks=ranks, special_tokens={})


def test_clashing_columns(spark, tmp_path, encoding):
    table = docs(spark, ["one two", "three", None])
    for name in ("tokens", "sign", "version", "documents"):
        table = table.withColumn(name, F.lit("mine"))
    rollup = tc.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.commit("b1", tc.inserts(tc.count_tokens(table, HOW)))
    tokens = sum(len(encoding.encode_ordinary(t)) for t in ("one two", "three"))
    assert sums(rollup, ["b1"]) == {("s", "en", "v1"): (3, tokens)}


def sums(rollup, batches):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals(batches).collect()}


def test_counts_whole_texts(spark, encoding):
    rows = tc.count_tokens(odd(spark), HOW).collect()
    texts = {r.doc_id: r.text for r in odd(spark).collect()}
    assert len(rows) == 10
    for r in rows:
        assert r.tokens == len(encoding.encode_ordinary(texts[r.doc_id] or ""))


def test_batches(spark, tmp_path, encoding):
    n = lambda text: len(encoding.encode_ordinary(text))
    rollup = tc.TokenRollup(spark, str(tmp_path / "r"))
    first = tc.count_tokens(docs(spark, ["one two", "three", "four five six"]), HOW)
    assert rollup.commit("b1", tc.inserts(first))
    key = ("s", "en", "v1")
    assert sums(rollup, ["b1"]) == {key: (3, n("one two") + n("three") + n("four five six"))}
    # The same batch again, even with other rows, changes nothing.
    assert not rollup.commit("b1", tc.inserts(first.unionByName(first)))
    gone = spark.createDataFrame([(1,), (77,), (1,)], "doc_id long")
    assert rollup.commit("b2", tc.deletes(rollup.current(["b1"]), gone))
    new = tc.count_tokens(docs(spark, ["one two and more"]), HOW)
    assert rollup.commit("b3", tc.revisions(rollup.current(["b1", "b2"]), new))
    assert sums(rollup, ["b1", "b2", "b3"]) == {key: (2, n("one two and more") + n("four five six"))}
    assert {r.doc_id for r in rollup.current(["b1", "b2", "b3"]).collect()} == {0, 2}
    # A revision under a new version leaves the old one in force.
    other = tc.count_tokens(docs(spark, ["x"]), tc.Tokenizer(HOW.path, HOW.pattern, "v2"))
    assert rollup.commit("b4", tc.revisions(rollup.current(["b1", "b2", "b3"]), other))
    assert sums(rollup, ["b1", "b2", "b3", "b4"])[("s", "en", "v2")] == (1, n("x"))
    everything = spark.createDataFrame([(i,) for i in range(3)], "doc_id long")
    assert rollup.commit("b5", tc.deletes(rollup.current(["b1", "b2", "b3", "b4"]), everything))
    assert sums(rollup, ["b1", "b2", "b3", "b4", "b5"]) == {}


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    rollup = tc.TokenRollup(spark, str(tmp_path / "r"))
    rows = tc.inserts(tc.count_tokens(docs(spark, ["a"]), HOW))
    rows.write.parquet(str(tmp_path / "r/ledger/batch=b1"))
    (tmp_path / "r/totals/batch=b1").mkdir(parents=True)
    assert not rollup.committed("b1") and sums(rollup, ["b1"]) == {}
    assert rollup.commit("b1", rows)
    assert sums(rollup, ["b1", "never"]) == {("s", "en", "v1"): (1, 1)}


def test_odd_rows_nulls_and_empty_batches(spark, tmp_path):
    rollup = tc.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.commit("none", tc.inserts(tc.count_tokens(empty(spark), HOW)))
    assert rollup.commit("odd", tc.inserts(tc.count_tokens(odd(spark), HOW)))
    got = sums(rollup, ["none", "odd"])
    want = Counter((r.source, r.lang) for r in odd(spark).collect())
    assert {k[:2]: v[0] for k, v in got.items()} == want
    # Repeated rows are counted, and taken back, as often as they are there.
    assert rollup.commit("out", tc.deletes(rollup.current(["none", "odd"]), spark.createDataFrame([(6,)], "doc_id long")))
    assert sums(rollup, ["none", "odd", "out"])[("b", "en", "v1")][0] == 1
    assert ("b", "fr", "v1") not in sums(rollup, ["none", "odd", "out"])
    with pytest.raises(ValueError):
        rollup.commit("../x", tc.inserts(tc.count_tokens(empty(spark), HOW)))


def test_query_equals_brute_force(spark, base):
    import re

    from rackline.llm.queries import op5_token_counts

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encode = tiktoken.Encoding("t", pat_str=HOW.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want, seen = {}, set()
    for r in spark.read.parquet(f"{base}/documents.parquet").orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            n, t = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (n + 1, t + len(encode(re.sub(r"([!?#*$%&])\1{2,}", r"\1", r.text or ""))))
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in op5_token_counts(spark, base).collect()}
    assert got == want

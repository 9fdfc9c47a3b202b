import random
import re
from collections import Counter

import pytest
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(inside),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab#") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["the same line again and again it is\n" * 5, "é" * 100, "a\x0bb\x0cc\rd\te", "a b c"]
    rows = quality.measure(docs(spark, texts)).select("text", *NAMES).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row)[1:] == brute(row.text)


def test_odd_rows_and_empty_table(spark):
    rows = quality.apply_rules(odd(spark)).collect()
    assert len(rows) == 10
    for row in rows:
        assert tuple(row[n] for n in NAMES) == brute(row.text)
        if not row.n_words:
            assert "n_words" in row.broken and not row.kept
    assert quality.apply_rules(empty(spark)).count() == 0


def test_clashing_and_extra_columns(spark):
    df = docs(spark, ["a b c"]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("more", F.lit(2))
    row = quality.apply_rules(df).first()
    assert row.n_words == 3 and row.kept is False and row.more == 2


@pytest.mark.parametrize("rule,kept", [(quality.Rule("n_words", low=3), True), (quality.Rule("n_words", high=2), False)])
def test_one_rule(spark, rule, kept):
    assert quality.apply_rules(docs(spark, ["a b c"]), [rule]).first().kept is kept


def test_labelled_rows_are_told_apart(spark, base):
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = quality.apply_rules(spark.read.parquet(f"{base}/documents.parquet")).join(labels, "doc_id")
    good = rows.where("quality = 1 AND n_words >= 20 AND n_repeat_words * 10 <= n_words * 3")
    assert good.where("kept").count() >= 0.97 * good.count()
    bad = rows.where("quality = 0")
    assert bad.where("NOT kept").count() >= 0.5 * bad.count()

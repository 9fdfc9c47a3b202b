import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm import substrings
from rackline.llm.suffixes import grouped_suffix_array


@pytest.mark.parametrize("letters", [1, 2, 4, 50])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for _ in range(200):
        x = np.concatenate((rng.integers(1, letters + 1, rng.integers(0, 40)), [0]))
        assert grouped_suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        cut = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                cut[i : i + 200] = True
        cut = cut[: len(b)]
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out.append((len(b), int(cut.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest()))
    return sorted(out)


def run(table):
    rows = substrings.remove_repeats(table).collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted((r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in rows)


def texts():
    rng = random.Random(4)

    def prose(n):
        return "".join(rng.choice("abcdefgh ä\n") for _ in range(n))

    passage, long = prose(260), prose(900)
    out = [None, "", "short", prose(199), long, long, "p" * 450, "ab" * 300, prose(150) + long[100:400] + prose(90)]
    for n in (198, 199, 200, 201):  # just too short, just long enough
        own = prose(n)
        out += [prose(70) + own + prose(30), prose(20) + own + prose(80)]
    out += [prose(rng.randrange(300)) + passage[rng.randrange(40) :] + prose(rng.randrange(300)) for _ in range(12)]
    edited = list(long)
    for i in (10, 250, 460, 700):
        edited[i] = "#"
    out += ["".join(edited), prose(40) + passage + prose(10) + passage]
    return out


def test_equals_brute_force(spark):
    assert run(docs(spark, texts())) == brute(texts())


def test_anchors_with_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 3)
    real = substrings.covered_spans
    monkeypatch.setattr(substrings, "covered_spans", lambda d, w: real(d, w, hot=2))
    assert run(docs(spark, texts())) == brute(texts())


def test_odd_rows_and_empty_table(spark):
    table = odd(spark)
    assert run(table) == brute([r.text for r in table.collect()])
    assert run(empty(spark)) == []


def test_clashing_columns(spark):
    table = docs(spark, texts())
    for name in ("uid", "spans", "n_bytes", "kept", "h", "contexts"):
        table = table.withColumn(name, F.lit("mine"))
    assert run(table) == brute(texts())

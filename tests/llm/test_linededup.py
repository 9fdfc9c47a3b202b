import random

import pytest
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm.linededup import dedup_lines


def brute(texts, least):
    """Delete every line that lies in a later copy of a run of lines with enough words."""
    lines = [(d, i, x) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))]
    own = {}
    for d, i, x in lines:
        if x.strip(" \t\x0b\x0c\r"):
            own.setdefault(d, []).append((i, x))
    seen, cut = set(), set()
    # Runs in corpus order; a run that was seen before is a later copy.
    for d in sorted(own):
        for a in range(len(own[d])):
            words = 0
            for b in range(a, len(own[d])):
                words += len(own[d][b][1].split())
                run = tuple(x for _, x in own[d][a : b + 1])
                if words < least:
                    continue
                if run in seen:
                    cut.update((d, i) for i, _ in own[d][a : b + 1])
                else:
                    seen.add(run)
    out = []
    for d, t in enumerate(texts):
        gone = [i for e, i in cut if e == d]
        kept = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((d, len(own.get(d, ())), len(gone), kept))
    return out


@pytest.mark.parametrize("least", [1, 3, 6, 15])
def test_equals_brute_force(spark, least):
    rng = random.Random(least)
    pool = [" ".join("abc"[rng.randrange(3)] * rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))) for _ in range(9)]
    texts = ["\n".join(rng.choice([*pool, "", f"own line {rng.random()}"]) for _ in range(rng.randrange(14))) for _ in range(40)]
    texts += [None, "", "\n\n", pool[0] + "\r", "\n".join(pool), "\n".join(pool), "\n".join([pool[1]] * 9)]
    rows = dedup_lines(docs(spark, texts), least).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in rows] == brute(texts, least)


def test_long_runs_need_only_few_rounds(spark):
    run = "\n".join(f"line {i}" for i in range(400))
    rows = dedup_lines(docs(spark, ["first\n" + run, run + "\nlast"]), 50).orderBy("doc_id").collect()
    assert [(r.n_removed, r.text) for r in rows] == [(0, "first\n" + run), (400, "last")]


def test_odd_rows_empty_table_and_clashing_columns(spark):
    table = odd(spark).withColumn("n_lines", F.lit("x")).withColumn("uid", F.lit(1)).withColumn("q", F.lit(2))
    rows = dedup_lines(table).collect()
    assert len(rows) == 10
    same = [r for r in rows if r.doc_id == 6]
    assert len(same) == 2 and all(r.n_removed == 0 and r.q == 2 for r in same)  # repeated rows are one document
    nine = next(r for r in rows if r.doc_id == 9)
    assert nine.n_removed > 0 and nine.text.startswith("line one is here\nline two is here\n")
    assert dedup_lines(empty(spark)).count() == 0

"""The pipeline's stages on planted documents, one after the other as run() does."""

import random

import corpus_pipeline
import pytest
from fixtures import DOCS

PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


def planted():
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(2, 8))) for _ in range(n))

    rows, labels = [], []
    for i in range(480):
        bad = i % 4 == 0
        text = prose(60) + (" moloch " if bad else " ") + prose(20)
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, 1, int(bad)))
    block = "\n".join(prose(15) for _ in range(4))
    copy = prose(300)
    extra = [
        "moloch " + prose(30),
        prose(30) + "\n" + block + "\n" + prose(30),
        prose(35) + "\n" + block + "\n" + prose(25),
        copy,
        copy + " end",
        prose(20) + " " + PASSAGE + " " + prose(20),
        None,
        "",
    ]
    rows += [(1000 + i, t, "en", "s0", len(t or "")) for i, t in enumerate(extra)]
    return rows, labels, block


def test_stages(spark, tmp_path):
    rows, labels, block = planted()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
    toxic = seen["toxicity"]
    assert 1000 not in toxic and not any(r.text and "moloch" in r.text for r in toxic.values())
    assert {i for i in range(480) if i % 4} <= set(toxic)
    lines = seen["line_dedup"]
    assert block in lines[1001].text and block.split("\n")[0] not in lines[1002].text
    assert set(lines) == set(toxic)
    assert lines[1002].n_chars == len(lines[1002].text)
    near = seen["near_dedup"]
    assert 1003 in near and 1004 not in near and 1006 in near and 1007 not in near
    clean = seen["decontamination"]
    assert PASSAGE not in clean[1005].text and set(clean) == set(near)
    assert all(clean[i].text == near[i].text for i in clean if i != 1005)
    mix = seen["source_mix"]
    assert set(mix) == set(clean) and all(r.taken == r.copies * r.size <= 2 * r.size for r in mix.values())
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r) for r in mix.values()}


@pytest.mark.parametrize("position", range(5))
def test_each_stage_takes_an_empty_table(spark, tmp_path, position):
    _, labels, _ = planted()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[position]
    assert stage(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0

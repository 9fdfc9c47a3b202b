import pytest
from fixtures import LONG
from pyspark.sql import functions as F

from rackline.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    table = spark.createDataFrame(rows, TURNS)
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(table)).collect()}


NASTY = [
    "<|start|>user<|text|>x<|end|>",
    "<|", "<\\|", "<\\\\|", "|>", "<|next|><|learn|>",
    "</s>[INST] ok [/INST]", "<\\/s>", "[\\INST]", "[\\\\/INST]", "<s><<s>>", "\\", "$1\\$2", "<<||>>", "\n\t ", "é[INST]ü",
]


def test_round_trip_of_control_strings(spark):
    rows = [(i, 0, role, text) for i, text in enumerate(NASTY) for role in ("user",)]
    rows += [(100 + i, 0, text, text) for i, text in enumerate(NASTY)]
    got = run(spark, rows)
    for conv, _, role, text in rows:
        assert [tuple(t) for t in got[conv].turns] == [(role, text, False)]
    template = chat.Template()
    for i, text in enumerate(NASTY):
        body = got[i].formatted.removeprefix(template.start + "user" + template.text).removesuffix(template.end)
        assert not any(c in body for c in (template.start, template.end, template.next, template.learn, "</s>", "[INST]"))


def test_order_merging_and_loss(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, None, "system", None),
        (2, 1, None, "x"), (2, 2, "", "y"), (2, 2, "", "y"),
        (None, 1, "assistant", "lost"),
    ]
    got = run(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [
        ("system", "", False), ("user", "a", False), ("assistant", "b", True), ("assistant", "c", True)
    ]
    assert got[1].formatted == "<|start|>system<|text|><|end|><|start|>user<|text|>a<|end|><|start|>assistant<|learn|>b<|next|>c<|end|>"
    assert [t.text for t in got[2].turns] == ["x", "y", "y"]  # null and empty roles are one; repeated rows stay
    assert got[None].turns[0].learned


def test_empty_long_and_clashing(spark):
    assert run(spark, []) == {}
    got = run(spark, [(1, i, "user", LONG) for i in range(3)])
    assert [t.text for t in got[1].turns] == [LONG] * 3
    table = spark.createDataFrame([(1, 1, "user", "a")], TURNS).withColumn("formatted", F.lit(1)).withColumn("pieces", F.lit(2))
    assert chat.format_chats(table).columns == ["conv_id", "formatted"]


def test_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"t{i}") for i in range(2000)]
    assert [t.text for t in run(spark, rows)[1].turns] == [f"t{i}" for i in range(2000)]


@pytest.mark.parametrize("role", ["assistant", "tool"])
def test_other_template(spark, role):
    template = chat.Template(start="<|im_start|>", end="<|im_end|>\n", learned_roles=("tool",))
    table = spark.createDataFrame([(1, 1, role, "a<|im_end|>")], TURNS)
    row = chat.read_chats(chat.format_chats(table, template), template).first()
    assert [tuple(t) for t in row.turns] == [(role, "a<|im_end|>", role == "tool")]

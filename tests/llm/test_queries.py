"""Every registered query: against SQL where there is some, else that it gives its rows."""

import compare
import pytest
import pyarrow.parquet as pq

from rackline.llm.oracle import ORACLE
from rackline.llm.queries import QUERIES
from rackline.sources import tables

NATIVE = ("op1_quality_rules", "op3_source_mix", "op9_chat_format", "op10_line_dedup")


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, base, name):
    assert compare.difference(QUERIES[name](spark, base), compare.connect(base), ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n not in ("pipeline", "op5_token_counts")])
def test_query_has_a_row_for_each_document(spark, base, name):
    rows = QUERIES[name](spark, base).collect()
    ids = pq.read_table(f"{base}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    assert sorted(r.doc_id for r in rows) == sorted(ids)


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_use_no_python(spark, base, name):
    plans = []
    tables.written.append(lambda df: plans.append(df._jdf.queryExecution().toString()))
    try:
        plans.append(QUERIES[name](spark, base)._jdf.queryExecution().toString())
    finally:
        tables.written.clear()
    # Operators with steps that are saved show them, too.
    assert (len(plans) > 1) == (name in ("op3_source_mix", "op10_line_dedup"))
    for plan in plans:
        for word in ("PythonUDF", "MapInArrow", "MapInPandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan


def test_registered_in_order_and_in_the_entry_module():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q.startswith("op")}

"""Every registered query against its SQL statement, and the shape of its plan."""

from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry_point
from checks.oracle import ORACLE
from checks.queries import REGISTRY as QUERIES
from rackline.sources import tables


@pytest.fixture(scope="module")
def connection(base):
    return compare.connect(base)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, base, connection, name):
    plans = []
    tables.written.append(lambda df: plans.append(df._jdf.queryExecution().toString()))
    try:
        with tables.intermediate_tables(spark) as folder:
            df = QUERIES[name](spark, base)
            assert compare.difference(df, connection, ORACLE[name]) is None
            plans.append(df._jdf.queryExecution().toString())
    finally:
        tables.written.clear()
    assert not Path(folder).exists()
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_entry(spark, base):
    rows = entry_point.entry(spark).collect()
    assert rows
    for metric in ("submissions", "job_runtime_seconds", "node_energy"):
        for cls in {r.gpu_node for r in rows}:
            assert sum(r[metric] for r in rows if r.gpu_node == cls) == pytest.approx(1, abs=1e-5)

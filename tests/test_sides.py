"""The joined table's two sides give what the joined table gives, without pairing its rows."""

import random

import pytest
from test_joins import JOB, SAMPLE, STATES, _jobs, _samples

from checks.queries import REGISTRY
from rackline.plans import energy, integration, peers
from rackline.sources import tables

#: Queries that pair no sample with a job.
UNPAIRED = ("peer_pairs", "peer_state_corr", "peer_state_corr_diff", "peer_state_corr_triangle", "runtime_by_class_state", "submissions_by_class_state", "state_counts_pivot",)
#: Queries that return pairs, which they neither write nor shuffle.
STREAMED = ("concurrent_jobs", "high_load_rows", "peer_state_counts",)


@pytest.fixture(scope="module")
def both(spark):
    """The sides and the joined table; one job has rows that overlap, some have no state."""
    rng = random.Random(12)
    samples, jobs = _samples(rng), _jobs(rng)
    jobs += [(j[0], j[1][:1], j[2], j[3], *j[4:]) for j in jobs[:20]]
    jobs = [j if j[0] % 9 else (*j[:4], None, *j[5:]) for j in jobs]
    sides = integration.Sides(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(jobs, JOB))
    return sides, tables.materialise(sides.pairs())


def _same(a, b):
    assert set(a.columns) >= set(b.columns) or set(b.columns) >= set(a.columns)
    columns = sorted(set(a.columns) & set(b.columns))
    assert columns

    def rows(df):
        return sorted(
            (tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())
        )

    found, want = rows(a), rows(b)
    assert want and found == want


ANALYSES = {
    "with_concurrency": integration.with_concurrency,
    "state_counts": lambda table: integration.state_counts(table, STATES),
    "submissions": energy.submissions_by_class_state,
    "runtime": energy.runtime_by_class_state,
    "high_load_rows": lambda table: peers.high_load_rows(table, 0.2),
    "peer_pairs": lambda table: peers.peer_pairs(peers.high_load_jobs(table, 0.2), STATES),
    "peer_state_corr": lambda table: peers.peer_state_corr(peers.high_load_jobs(table, 0.2), STATES),
    "peer_state_counts": lambda table: peers.peer_state_counts(peers.high_load_jobs(table, 0.2), STATES),
}


@pytest.mark.parametrize("name", ANALYSES)
def test_sides_equal_the_joined_table(both, name):
    sides, joined = both
    _same(ANALYSES[name](sides), ANALYSES[name](joined))


@pytest.mark.parametrize("name", [*UNPAIRED, *STREAMED])
def test_joined_rows_are_not_stored(spark, base, name):
    plans = []
    tables.written.append(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()))
    try:
        with tables.intermediate_tables(spark):
            plan = REGISTRY[name](spark, base)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        tables.written.clear()
    assert plans
    assert not [p for p in plans if "_point_bucket" in p]
    assert ("_point_bucket" in plan) == (name in STREAMED)


def test_pairs_are_listed_without_work_on_each(spark, base):
    plan = REGISTRY["interval_join_pairs"](spark, base)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "round(" not in above and "timestampdiff" not in above.lower() and "size(" not in above
    assert "round(" in plan and "timestampdiff" in plan.lower()


def test_a_stored_count_is_that_of_the_joined_rows(both):
    sides, joined = both
    counted = tables.materialise(integration.with_concurrency(sides))
    _same(energy.job_nodes(counted), energy.job_nodes(joined))


def test_joined_rows_are_not_shuffled_once_they_are_stored(spark, base):
    with tables.intermediate_tables(spark):
        result = REGISTRY["named_tables"](spark, base)
        assert "Join" not in result._jdf.queryExecution().optimizedPlan().toString()
        assert result.collect()

"""Physical-plan guards for every registered query (the scale rules, checked mechanically)."""

import pytest

import __spark_entry__ as entry
from affinity.plans.registry import QUERIES
from inputs import SMOKE

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_or_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SMOKE))
    assert not [f for f in FORBIDDEN if f in plan]


def test_batch_ranking_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["recommend_batch"](spark, SMOKE)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "WindowGroupLimit" in text


def test_scan_pushdown_and_pruning(spark):
    text = _plan(entry.queries()["insert_dependencies"](spark, SMOKE))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in text or "LessThan(l_shipdate" in text
    assert "l_quantity" not in text  # columns not used are not read

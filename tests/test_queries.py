"""Every query against its SQL in another engine; the others must run."""

import pytest

from remembrane.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).toPandas() is not None


def test_plans_have_no_cartesian_product(spark, sf):
    for name in ("facts_conflicts", "reconcile_diff", "resolve_tiers", "recall_hybrid"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name


def test_filter_reaches_the_scan(spark, sf):
    plan = QUERIES["meta_containment"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema:")[1]


def test_entry_points():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

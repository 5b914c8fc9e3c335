"""Every registered query runs; those with SQL give DuckDB's rows."""

import pytest

from tests.compare import DATA, same_rows
from trailmark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, DATA), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_near_joins_have_no_cartesian_plan(spark):
    for name in ("places_nearest", "track_merge", "track_place_point", "track_find_point"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

"""Every registered query against its SQL on the smallest given tables, and rules for its plan."""

import os

import pytest

from tabquest.registry import all_oracles, all_queries
from tools.compare import oracle_connection, oracle_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not found")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_its_sql(spark, connection, name):
    df = all_queries()[name](spark, SF_DIR)
    columns, expected = oracle_rows(connection, all_oracles()[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_entry_runs(spark):
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0

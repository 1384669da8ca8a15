"""Every registered query against its oracle on the smallest tables, and plan rules that hold for all of them."""

import os

import pytest

import __spark_entry__ as entry
from workload.catalog import all_oracles, all_queries
from workload.check import rows_of
from workload.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
NAMES = list(all_queries())


@pytest.fixture(scope="module")
def con():
    import duckdb
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    cols, rows = rows_of(df.columns, df.collect())
    sql = all_oracles().get(name)
    if sql is not None:
        rel = con.sql(sql)
        want_cols, want = rows_of(list(rel.columns), rel.fetchall())
        assert cols == want_cols
        assert rows == want


def test_every_query_has_an_oracle_and_is_registered():
    assert set(NAMES) == set(all_oracles()) and set(NAMES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

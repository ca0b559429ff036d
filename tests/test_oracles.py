"""Every registered query against its oracle SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from checks.fixtures import TABLES
from checks.oracles import ORACLES
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    answer = duck.execute(ORACLES[name])
    order = [d[0] for d in answer.description]
    assert sorted(order) == columns
    want = [tuple(r[order.index(c)] for c in columns) for r in answer.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)

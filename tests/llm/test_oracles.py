"""The queries with oracle SQL, on the smallest tables, and the rest of the registry."""

import os

import duckdb
import pytest

from corpuslens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(answer.fetchall(), key=key)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_gives_a_row_for_each_document(spark, name):
    ids = QUERIES[name](spark, SF).select("doc_id").distinct().count()
    assert ids == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()

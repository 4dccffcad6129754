"""Training-data queries against DuckDB's SQL where there is any, and all of them at the smallest size."""

from pathlib import Path

import duckdb
import pytest

from loomframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = QUERIES[name](spark, DATA)
    wanted = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert found.columns == columns
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op10_order_minhash"}))
def test_one_row_per_document(spark, name):
    found, documents = QUERIES[name](spark, DATA), spark.read.parquet(f"{DATA}/documents.parquet")
    assert "doc_id" in found.columns
    if name != "op4_spaced_seed_leaks":
        assert found.count() == documents.count()

"""Every query of the library against the same in DuckDB's SQL, at the smallest size."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from loomframe.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=key)
    wanted = duck.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(wanted.description)}
    assert sorted(at) == columns
    assert got == sorted((tuple(plain(r[at[c]]) for c in columns) for r in wanted.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, duck, name):
    assert QUERIES[name](spark, DATA).count() > 0

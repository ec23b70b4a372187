"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from figloom.plans import reference_queries, training_queries

DATA = Path("/root/testdata/sf0.001")
QUERIES = reference_queries.QUERIES | training_queries.QUERIES
ORACLE = reference_queries.ORACLE | training_queries.ORACLE
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    sql = tables.execute(ORACLE[name])
    columns = sorted(d[0] for d in sql.description)
    assert sorted(df.columns) == columns
    at = [[d[0] for d in sql.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0

"""Every registered query of the reference operators against its SQL in DuckDB."""

import os

import duckdb
import pytest

from folia.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    q = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in q.fetchall())

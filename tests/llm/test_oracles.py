"""The queries of this package that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from ladderlens.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, found: sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found), key=repr)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())

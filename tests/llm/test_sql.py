"""Queries with DuckDB SQL give its rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapweave.llm import queries  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMOKE)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMOKE}/{table}.parquet')")
    want = con.execute(queries.ORACLE[name])
    assert [c[0] for c in want.description] == got.columns
    in_order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))
    assert in_order(got.collect()) == in_order(want.fetchall())

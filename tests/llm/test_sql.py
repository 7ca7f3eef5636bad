"""Every query that has SQL, compared with DuckDB over whole tables."""

import os

import duckdb
import pytest

from pressroom.llm.queries import QUERIES, SQL
from tests.conftest import SF01


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{os.path.join(SF01, t)}.parquet'")
    got, want = QUERIES[name](spark, SF01), con.sql(SQL[name])
    columns = sorted(want.columns)
    rows = lambda names, values: sorted(str([r[names.index(c)] for c in columns]) for r in values)
    expected = want.fetchall()
    assert sorted(got.columns) == columns and len(expected) > 0
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, expected)

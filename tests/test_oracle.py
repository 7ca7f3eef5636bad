"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate),
plus the smoke entry at sf0.001."""

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF01
from tests.oracle_util import diff, duck, oracle_rows, spark_rows

QUERIES = entry_mod.queries()
ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == entry_mod.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    res = spark_rows(df)
    exp = oracle_rows(con, ORACLES[name])
    problem = diff(res, exp, places=12)
    assert problem is None, f"{name}: {problem}"
    rel = con.sql(ORACLES[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types, f"{name}: types differ"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF01)
    assert df.count() >= 0

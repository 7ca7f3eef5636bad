"""Compare a Spark result with a DuckDB oracle the way the driver does: same column names,
same row count, same multiset of rows (floats compared after rounding)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, places: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, places)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), places)
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, places)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x, places) for x in v)
    return v


def normalise(columns, rows, places: int = 5):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i], places) for i in order) for r in rows]
    out.sort(key=repr)
    return cols, out


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def diff(spark_res, oracle_res, places: int = 5) -> str | None:
    sc, sr = normalise(*spark_res, places=places)
    oc, orows = normalise(*oracle_res, places=places)
    if sc != oc:
        return f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orows):
        return f"row count differs: spark={len(sr)} oracle={len(orows)}"
    for a, b in zip(sr, orows):
        if a != b:
            return f"first differing row:\n spark ={a}\n oracle={b}"
    return None

"""Run every registered query against its DuckDB oracle.

    python -m pressroom.plans.check [sf_dir] [--tz ZONE] [--no-aqe] [query ...]

Compares column names, row counts and the multiset of rows (floats rounded to 12 decimals),
like the correctness gate, and prints one line per query plus a summary. Used to check the
queries at other scale factors and session settings than the test suite's.
"""

from __future__ import annotations

import argparse
import datetime as dt
import math

import duckdb

from pressroom.plans import catalog  # noqa: F401  (registers the queries)
from pressroom.plans.registry import REGISTRY
from pressroom.session import build_session
from pressroom.sources.tables import TABLES


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 12) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("queries", nargs="*")
    ap.add_argument("--tz", default="UTC")
    ap.add_argument("--no-aqe", action="store_true")
    a = ap.parse_args()
    spark = build_session(extra={"spark.sql.session.timeZone": a.tz,
                                 "spark.sql.adaptive.enabled": str(not a.no_aqe).lower()})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf_dir}/{t}.parquet')")
    names = a.queries or sorted(n for n, q in REGISTRY.items() if q.sql)
    bad = []
    for name in names:
        df = REGISTRY[name].fn(spark, a.sf_dir)
        got = _rows(df.columns, [tuple(r) for r in df.collect()])
        cur = con.execute(REGISTRY[name].sql)
        exp = _rows([d[0] for d in cur.description], cur.fetchall())
        ok = got == exp
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} ({len(got[1])} rows)")
    print(f"{len(names) - len(bad)}/{len(names)} match at {a.sf_dir} (tz={a.tz}, aqe={not a.no_aqe})")
    spark.stop()


if __name__ == "__main__":
    main()

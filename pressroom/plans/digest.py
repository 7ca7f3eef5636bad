"""Plan digest of every registered query, as a markdown table.

    python -m pressroom.plans.digest [sf_dir] > PLANS.md

Per query: the tables scanned with the number of columns read and the filters pushed into
the scan, the number of shuffles, the join strategies, windows (and window group limits),
and any Python node -- read off ``explain("formatted")`` of the initial adaptive plan.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from pressroom.plans import catalog  # noqa: F401  (registers the queries)
from pressroom.plans.registry import REGISTRY
from pressroom.session import build_session

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow")
SKIP: set[str] = set()


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def digest(plan: str) -> dict[str, str]:
    nodes = re.split(r"\n(?=\(\d+\) )", plan)
    scans = []
    for n in nodes:
        if not re.match(r"\(\d+\) Scan (parquet|binaryFile)", n):
            continue
        table = re.search(r"Location: \w+ \[[^\]]*/([\w.]+?)(?:\.parquet)?[,\]]", n)
        schema = re.search(r"ReadSchema: struct<(.*)>", n)
        pushed = re.search(r"PushedFilters: \[(.*)\]", n)
        ncols = len(re.findall(r"(?:^|,)\w+:", schema.group(1))) if schema else 0
        filt = pushed.group(1) if pushed and pushed.group(1) else ""
        scans.append(f"{table.group(1) if table else '?'}({ncols} cols{'; ' + filt if filt else ''})")
    count = lambda pat: len(re.findall(pat, plan, flags=re.M))
    joins = []
    for kind in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
                 "CartesianProduct"):
        k = count(rf"^\(\d+\) {kind}")
        if k:
            joins.append(f"{k} {kind}")
    return {
        "scans": ", ".join(scans),
        "shuffles": str(count(r"^\(\d+\) Exchange")),
        "joins": ", ".join(joins) or "-",
        "windows": f"{count(r'^\(\d+\) Window\s*$')} / {count(r'^\(\d+\) WindowGroupLimit')}",
        "python": ", ".join(n for n in PY_NODES if n in plan) or "-",
    }


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session()
    print("| query | jobs | scans (columns read; pushed filters) | shuffles | joins | windows / group limits | python |")
    print("|---|---|---|---|---|---|---|")
    for name in sorted(REGISTRY):
        q = REGISTRY[name]
        if name in SKIP:
            print(f"| {name} | {','.join(q.jobs)} | writes then reads files (see module doc) | | | | |")
            continue
        d = digest(formatted(q.fn(spark, sf_dir)))
        print(f"| {name} | {','.join(q.jobs)} | {d['scans']} | {d['shuffles']} | {d['joins']} | {d['windows']} | {d['python']} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

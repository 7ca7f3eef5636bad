"""Print the formatted physical plan of registered queries.

    python -m pressroom.plans.explain [sf_dir] [query ...]
"""

from __future__ import annotations

import sys

from pressroom.plans import catalog  # noqa: F401  (registers the queries)
from pressroom.plans.registry import REGISTRY
from pressroom.session import build_session


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(REGISTRY)
    spark = build_session()
    for name in names:
        q = REGISTRY[name]
        print(f"===== {name}  jobs={','.join(q.jobs)}  survey={','.join(q.survey_ids)}")
        q.fn(spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

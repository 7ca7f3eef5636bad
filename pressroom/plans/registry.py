"""Registry of named queries over the driver tables, each with an optional SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    jobs: tuple[str, ...]
    survey_ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, *, sql: str | None, jobs: tuple[str, ...] = (), ids: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(jobs), tuple(ids))
        return fn
    return deco

"""Join helpers: null-safe key joins, and broadcasting behind a check of the size in bytes.

``bounded_broadcast`` cuts the lineage of a side that is small by construction (one row per
group, a caller's dimension) with ``checkpoint()`` into the shared checkpoint folder, measures
its rows and longest values, and marks it for broadcast only when that bound is within the
session's ``spark.sql.autoBroadcastJoinThreshold``. Beyond it the join stays a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.session import cut_lineage

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def threshold_bytes(spark) -> int:
    """The session's broadcast threshold in bytes (negative: never)."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def size_bound(df: DataFrame) -> int:
    """Upper bound of the bytes of ``df`` as rows: 16 per fixed column and row, the longest
    value (as JSON for nested columns) per other column and row. One aggregate."""
    def width(f):
        c = F.col(f"`{f.name}`")
        return F.coalesce(F.max(F.octet_length(c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c)))), F.lit(0))
    wide = [f for f in df.schema.fields if not isinstance(f.dataType, FIXED)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[width(f).alias(f"w{i}") for i, f in enumerate(wide)]).first()
    return row["n"] * (16 * len(df.columns) + 16 + sum(row[f"w{i}"] for i in range(len(wide))))


def bounded_broadcast(small: DataFrame, max_bytes: int | None = None, materialize: bool = True) -> tuple[DataFrame, bool]:
    """``small``, wrapped in a broadcast hint when its size is within ``max_bytes`` (default: the
    session's threshold). A computed side is materialised first (checkpoint into the shared
    folder: measured once, reused by the join, survives executor loss); a stored table
    (``materialize=False``) is just measured -- re-reading it is deterministic."""
    if materialize:
        small = cut_lineage(small)
    limit = threshold_bytes(small.sparkSession) if max_bytes is None else max_bytes
    if size_bound(small) <= limit:
        return F.broadcast(small), True
    return small, False


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int | None = None) -> DataFrame:
    """Join ``big`` with a side expected to be small; broadcast only after the size check."""
    side, _ = bounded_broadcast(small, max_bytes)
    return big.join(side, on, how)


def join_keys(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where null equals null; the right side's keys are dropped."""
    names = {k: f"_right_{k}" for k in key}
    side = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(side[f"`{names[k]}`"]) for k in key])
    joined = left.join(side, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def broadcast_local(df: DataFrame) -> DataFrame:
    """Broadcast a frame built on the driver from caller data (a Python list or dict):
    its size is known before the job starts, so no check is needed."""
    return F.broadcast(df)

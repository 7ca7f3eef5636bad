"""J8 ingest audit: status per article and running counters.

Running counters over a whole log are prefix sums: ``operators.running`` range-partitions the log
by its order, sums each partition and adds what came before, so no task holds more than a partition.

Status follows the crawl log: ``failed`` when the fetch returned nothing, ``duplicate`` when
an earlier successful fetch wrote the same key, else ``ok``. "Earlier" is decided by a
grouped ``min`` per key joined back (skew-safe: partial aggregation, AQE skew join), not by a
per-key window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.operators.joins import join_keys
from pressroom.operators.running import running_sums

STATUS_OK, STATUS_FAILED, STATUS_DUPLICATE = "ok", "failed", "duplicate"


def _first_fetches(base: DataFrame, key: list[str], ts: str, tiebreak: str) -> DataFrame:
    """One row per key: the smallest (ts, tiebreak) among its non-failed fetches."""
    return (base.filter(~F.col("_failed"))
                .groupBy(*key).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("i"))).alias("_first")))


def _with_status(base: DataFrame, firsts: DataFrame, key: list[str], ts: str, tiebreak: str) -> DataFrame:
    j = join_keys(base, firsts, key, "left")
    is_first = F.col("_first.t").eqNullSafe(F.col(ts)) & F.col("_first.i").eqNullSafe(F.col(tiebreak))
    status = (F.when(F.col("_failed"), F.lit(STATUS_FAILED))
               .when(F.coalesce(is_first, F.lit(False)), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_DUPLICATE)))
    return j.withColumn("status", status).drop("_first")


def fetch_status(df: DataFrame, key: Sequence[str], ts: str, tiebreak: str, failed: Column) -> DataFrame:
    """Adds ``status``: failed / duplicate / ok (first non-failed fetch of its key, by
    ``(ts, tiebreak)``; ``tiebreak`` must be unique per row, e.g. a fetch id). A null in the key
    is a value like any other."""
    key = list(key)
    base = df.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    return _with_status(base, _first_fetches(base, key, ts, tiebreak), key, ts, tiebreak).drop("_failed")


def running_counters(df: DataFrame, ts: str, tiebreak: str, values: Mapping[str, Column]) -> DataFrame:
    """Adds one running-sum column per entry of ``values`` in ``(ts, tiebreak)`` order (nulls first)."""
    return running_sums(df, values, [F.col(ts).asc_nulls_first(), F.col(tiebreak)])


def ingest_audit(df: DataFrame, key: Sequence[str], ts: str, tiebreak: str, failed: Column,
                 n_comments: Column) -> DataFrame:
    """Status per fetch plus running ``seq`` (file number), ``ok_count``, ``fail_count``
    and ``total_comments`` (comments fetched so far; a failed fetch brings none)."""
    s = fetch_status(df.withColumn("n_comments", n_comments), key, ts, tiebreak, failed)
    st = F.col("status")
    return running_counters(s, ts, tiebreak, {
        "seq": F.lit(1).cast("long"),
        "ok_count": (st == STATUS_OK).cast("long"),
        "fail_count": (st == STATUS_FAILED).cast("long"),
        "total_comments": F.when(st == STATUS_FAILED, F.lit(0)).otherwise(F.coalesce(F.col("n_comments"), F.lit(0))).cast("long"),
    })


def audit_totals(audit: DataFrame) -> DataFrame:
    """Fetches and comments per status."""
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n_fetches"),
                                       F.sum(F.coalesce("n_comments", F.lit(0))).cast("long").alias("n_comments"))

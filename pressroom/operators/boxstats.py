"""J15 box-plot statistics and J16 comment-length distribution.

Plan: the value columns are unpivoted to ``(group, metric, value)`` rows; (1) quartiles,
n and mean per (group, metric) -- exact by band refinement (``operators.quantiles``: no task
holds a whole hot group) or, with ``exact=False``, ``percentile_approx``; (2) the per-group
result, one row per (group, metric), is checkpointed, counted and broadcast to the rows, and
a grouped aggregate takes the whiskers (extreme values inside the 1.5 x IQR fences) and
counts outliers. Every shuffle carries partial aggregates, never a group's raw values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.operators.joins import bounded_broadcast
from pressroom.operators.profile import not_nan
from pressroom.operators.quantiles import DEFAULT_ACCURACY, exact_quantiles


def _fenced(df: DataFrame, by: str, cols: Iterable[str], whis: float, exact: bool, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """The values as rows (by, metric, _val), and the quartiles and fences of each group."""
    cols = list(cols)
    g = F.col(by)
    wide = df.select(g.alias(by), *[not_nan(F.col(c)).alias(c) for c in cols]).filter(g.isNotNull())
    long = wide.unpivot([by], cols, "metric", "_val")
    keys = [by, "metric"]
    if exact:
        stats = exact_quantiles(long, keys, "_val", [0.25, 0.5, 0.75], accuracy,
                                extra_aggs={"mean": F.avg("_v")})
    else:
        v = F.col("_val")
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        stats = (long.filter(v.isNotNull()).groupBy(*keys)
                     .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), q.alias("_q"))
                     .select(*keys, "n", "mean", *[F.col("_q")[i].alias(f"q{i}") for i in range(3)]))
    iqr = F.col("q2") - F.col("q0")
    stats = stats.withColumns({"_lo": F.col("q0") - F.lit(whis) * iqr, "_hi": F.col("q2") + F.lit(whis) * iqr})
    return long, bounded_broadcast(stats)[0]


def outliers(df: DataFrame, by: str, cols: Iterable[str], whis: float = 1.5, exact: bool = True, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """The points a box plot draws beyond its whiskers: ``by, metric, value, n`` -- every distinct
    value outside the fences with the number of its rows, so equal points are counted before they
    meet. Groups as in :func:`box_stats`."""
    long, stats = _fenced(df, by, cols, whis, exact, accuracy)
    v = F.col("_val")
    beyond = long.join(stats.select(by, "metric", "_lo", "_hi"), [by, "metric"]).filter((v < F.col("_lo")) | (v > F.col("_hi")))
    return beyond.groupBy(by, "metric", v.cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: str, cols: Iterable[str], whis: float = 1.5, exact: bool = True,
              accuracy: int = DEFAULT_ACCURACY, places: int | None = 6) -> DataFrame:
    """Long result: ``by, metric, n, mean, q1, median, q3, whisker_lo, whisker_hi,
    n_outliers`` (matplotlib / seaborn box-plot rules). Nulls in the value are ignored;
    rows with a null group key are dropped."""
    long, stats_b = _fenced(df, by, cols, whis, exact, accuracy)
    keys = [by, "metric"]
    v = F.col("_val")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    whiskers = (long.join(stats_b.select(*keys, "_lo", "_hi"), keys)
                    .groupBy(*keys).agg(F.min(F.when(inside, v)).alias("whisker_lo"),
                                        F.max(F.when(inside, v)).alias("whisker_hi"),
                                        F.count_if(v.isNotNull() & ~inside).alias("n_outliers")))

    def r(c):
        return F.round(c, places) if places is not None else c

    return stats_b.join(whiskers, keys).select(
        by, "metric", "n", r(F.col("mean")).alias("mean"), r(F.col("q0")).alias("q1"),
        r(F.col("q1")).alias("median"), r(F.col("q2")).alias("q3"), "whisker_lo", "whisker_hi", "n_outliers")


def length_distribution(df: DataFrame, by: str, text: str = "comments", **kw) -> DataFrame:
    """Comment length in code points (null stays null) per group, as box statistics."""
    return box_stats(df.select(by, F.length(text).alias("comment_length")), by, ["comment_length"], **kw)

"""J12 visibility ratios (hidden vs shown comments), overall and per press.

One pass of conditional counts (``count_if``) per group: partial aggregation on the map side,
one small shuffle of per-group counters, no pivot and no window. Rows whose ``visible`` or
press is null are left out of numerators and denominators alike (SURVEY T12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visibility_counts(df: DataFrame, visible: str = "visible") -> DataFrame:
    """Overall: one row per ``visible`` value with its count and % of the non-null total.

    Labels travel with the value, not with the row position (SURVEY T9). Rows come out
    count-descending, ties by value.
    """
    v = F.col(visible)
    totals = df.agg(
        F.count_if(v).alias("n_true"),
        F.count_if(~v).alias("n_false"),
    )
    long = totals.select(
        F.inline(F.array(
            F.struct(F.lit(True).alias("visible"), F.col("n_true").alias("n_comments")),
            F.struct(F.lit(False).alias("visible"), F.col("n_false").alias("n_comments")),
        )),
        (F.col("n_true") + F.col("n_false")).alias("n_total"),
    )
    return (long.filter(F.col("n_comments") > 0)
                .select("visible", "n_comments",
                        (F.col("n_comments") / F.col("n_total") * 100).alias("pct"))
                .orderBy(F.desc("n_comments"), F.desc("visible")))


def visibility_by(df: DataFrame, by: str, visible: str = "visible") -> DataFrame:
    """Per group: hidden / shown counts (absent cell = 0) and row-normalised shares (0..1)."""
    v = F.col(visible)
    g = F.col(by)
    counts = (df.filter(g.isNotNull() & v.isNotNull())
                .groupBy(g.alias(by))
                .agg(F.count_if(~v).alias("n_hidden"), F.count_if(v).alias("n_shown")))
    n = F.col("n_hidden") + F.col("n_shown")
    return counts.select(
        by, "n_hidden", "n_shown",
        (F.col("n_hidden") / n).alias("hidden_ratio"),
        (F.col("n_shown") / n).alias("shown_ratio"),
    )


def visibility_ratio(df: DataFrame, by: str | None = None, visible: str = "visible") -> DataFrame:
    return visibility_counts(df, visible) if by is None else visibility_by(df, by, visible)

"""J13 time parts and J14 time histograms.

Parts are taken on the source wall clock (TIMESTAMP_NTZ, SURVEY T1). A histogram is one
grouped count: partial counts per task, one shuffle of at most (#parts x #tasks) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.functions.timeparts import wall_clock, weekday_name, year_month

PARTS = {
    "year": lambda c: F.year(c),
    "hour": lambda c: F.hour(c),
    "weekday": lambda c: weekday_name(c),
    "year_month": lambda c: year_month(c),
}

# Dense domains for parts with a fixed range.
DENSE = {"hour": (0, 23)}
# --- fixed values -------------------------------------------------------------------------
# Day names in week order, as ``date_format(ts, 'EEEE')`` prints them.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# ------------------------------------------------------------------------------------------


def time_parts(df: DataFrame, ts: str, keep_unparsable: bool = True) -> DataFrame:
    """Adds ``year, hour, weekday, year_month``; ``ts`` becomes the wall-clock NTZ value.
    Unparsable values give null parts (never the text 'NaT', SURVEY T27)."""
    out = df.withColumn(ts, wall_clock(ts))
    if not keep_unparsable:
        out = out.filter(F.col(ts).isNotNull())
    return out.withColumns({name: fn(F.col(ts)) for name, fn in PARTS.items()})


def unparsable_count(df: DataFrame, ts: str) -> DataFrame:
    """How many non-null inputs fail to parse as a timestamp."""
    return df.agg(F.count_if(F.col(ts).isNotNull() & wall_clock(ts).isNull()).alias("n_unparsable"))


def time_histogram(df: DataFrame, ts: str, part: str = "hour", dense: bool = False) -> DataFrame:
    """Count of rows per time part, in part order; only parts that occur unless ``dense``."""
    value = PARTS[part](wall_clock(ts))
    counts = (df.select(value.alias(part)).filter(F.col(part).isNotNull())
                .groupBy(part).agg(F.count(F.lit(1)).alias("n_comments")))
    if dense:
        # The domain is generated (24 hours, 7 days, or the months / years between the first
        # and last seen), never a scan or a join partner that grows with the data.
        one = counts.sparkSession.range(1)
        if part in DENSE:
            lo, hi = DENSE[part]
            domain = one.select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(part))
        elif part == "weekday":
            domain = one.select(F.explode(F.array(*[F.lit(d) for d in WEEKDAYS])).alias(part))
        elif part in ("year_month", "year"):
            # Every month (year) between the first and the last one seen: a one-row aggregate
            # of the counts generates the domain inside the plan, no driver round trip.
            bounds = counts.agg(F.min(part).alias("_lo"), F.max(part).alias("_hi"))
            if part == "year":
                domain = bounds.select(F.explode(F.sequence("_lo", "_hi")).alias(part))
            else:
                first = F.to_date(F.concat(F.col("_lo"), F.lit("-01")))
                last = F.to_date(F.concat(F.col("_hi"), F.lit("-01")))
                domain = bounds.select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("_d")) \
                               .select(F.date_format("_d", "yyyy-MM").alias(part))
        else:
            raise ValueError(f"no dense domain for {part}")
        counts = (domain.join(counts, part, "left")
                        .select(part, F.coalesce("n_comments", F.lit(0)).alias("n_comments")))
    if part == "weekday":
        pos = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(part))
        return counts.orderBy(pos)
    return counts.orderBy(part)

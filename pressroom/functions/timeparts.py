"""Timestamp expressions on the source wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names as pandas ``day_name()`` prints them (Spark's ``dayname`` gives 'Thu').
WEEKDAY_FORMAT = "EEEE"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def wall_clock(col: Column | str) -> Column:
    """ISO text (with or without zone) or timestamp -> TIMESTAMP_NTZ keeping the wall clock.

    ``2024-12-05T00:30:15+0900`` stays ``2024-12-05 00:30:15``; unparsable -> null.
    """
    return _c(col).try_cast("timestamp_ntz")


def year_month(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def weekday_name(col: Column | str) -> Column:
    return F.date_format(_c(col), WEEKDAY_FORMAT)


def cutoff_filter(col: Column | str, cutoff: str, inclusive_day: bool = False) -> Column:
    """``ts <= cutoff`` (the reference's midnight rule) or the whole cutoff day when asked."""
    c = _c(col)
    bound = F.to_timestamp_ntz(F.lit(cutoff))
    if inclusive_day:
        return c < F.date_add(F.to_date(F.lit(cutoff)), 1).cast("timestamp_ntz")
    return c <= bound

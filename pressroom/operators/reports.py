"""Composed keyword reports: the reference's two keyword flows as one call each.

* ``monthly_keywords`` (D6 by month, D7, U4, B2, B3, T2): wall-clock time, optional cutoff,
  drop null comments / times, ``year_month``, then the top ``n`` tokens and the token and
  comment totals per month.
* ``group_keywords`` (D6 by press group, B1, B13, T7, T8): group assignment, file-name month
  window, top ``n`` tokens per group.
* ``emotion_report`` (D8, J17 -> J20 -> J23): month-scope mean scores per press, the
  ``Year-Month-Media`` summary, shares of each key's total, and mean shares per press group
  and month with stack offsets -- the chain whose hand-overs the reference leaves to files.

Both are the same Catalyst operators as the individual jobs (no extra shuffles beyond the
token count and the top-N window), returned as ``(top, totals)`` frames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.operators import clean, groups, scores, shares, tokens
from pressroom.operators.timeprofile import time_parts


def monthly_keywords(df: DataFrame, text: str = "comments", ts: str = "regTime", n: int = 20,
                     cutoff: str | None = None, inclusive_day: bool = False, **token_kw) -> tuple[DataFrame, DataFrame]:
    rows = df.select(text, ts).filter(F.col(text).isNotNull())
    rows = clean.filter_period(rows, ts, cutoff=cutoff, inclusive_day=inclusive_day)
    rows = time_parts(rows, ts, keep_unparsable=False).select(text, "year_month")
    return (tokens.top_tokens(rows, "year_month", n=n, text=text, **token_kw),
            tokens.token_totals(rows, "year_month", text=text, **token_kw))


def group_keywords(df: DataFrame, group_map: Mapping[str, Iterable[str]], text: str = "comments",
                   press: str = "press_name", file_name: str | None = "file_name",
                   start: str | None = None, end: str | None = None, mode: str = "range",
                   n: int = 30, other: str = groups.OTHER, **token_kw) -> tuple[DataFrame, DataFrame]:
    rows = df.filter(F.col(text).isNotNull())
    if file_name is not None and start is not None and end is not None:
        rows = clean.filter_name_months(rows, file_name, start, end, mode=mode)
    rows = groups.assign_group(rows.select(press, text), group_map, press=press, other=other)
    return (tokens.top_tokens(rows, "group", n=n, text=text, **token_kw),
            tokens.token_totals(rows, "group", text=text, **token_kw))


def emotion_report(df: DataFrame, scorer, group_map: Mapping[str, Iterable[str]], press: str = "press_name",
                   month: str = "month", file: str = "file_name", text: str = "comments",
                   other: str | None = groups.OTHER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(month_scores, shares_long, group_month_shares)``; ``month`` holds ``YYYY-MM``."""
    month_scores = scores.mean_scores(df, scorer, press=press, month=month, file=file, text=text, scope="month")
    summary = shares.summary_from_scores(month_scores, scorer.labels, press=press, month=month)
    long = shares.emotion_share(summary, scorer.labels)
    return month_scores, long, shares.group_month_share(long, group_map, order=scorer.labels, other=other)

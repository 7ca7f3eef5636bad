"""J9 period filters and J10 null / blank handling.

All filters are plain Catalyst predicates: on parquet input they reach the scan
(``PushedFilters``); derived predicates (month from a file name) run in the same
whole-stage-codegen span as the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions.text import NA_TOKENS, has_text, null_if_na
from pressroom.functions.timeparts import cutoff_filter, wall_clock


def require_columns(df: DataFrame, required: Iterable[str] = (), optional: Iterable[str] = ()) -> list[str]:
    """Refuse when a required column is missing; return the optional ones that exist.
    Schema metadata only -- no job runs."""
    cols = set(df.columns)
    missing = [c for c in required if c not in cols]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return [c for c in optional if c in cols]


def name_month(name_col: Column | str) -> tuple[Column, Column]:
    """(year, month) ints from a leading ``YYYY-MM`` in a file name; null when unparsable."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    first = F.split(c, "_", 2).getItem(0)
    parts = F.split(first, "-")
    y = F.get(parts, 0).try_cast("int")
    m = F.get(parts, 1).try_cast("int")
    return y, m


def filter_name_months(df: DataFrame, name_col: str, start: str, end: str,
                       mode: str = "range") -> DataFrame:
    """Keep rows whose file-name month lies in ``[start, end]`` (``YYYY-MM``).

    ``mode='as_written'`` reproduces the reference's rule: drop only months before ``start``
    in start's year and after ``end`` in end's year; every other year passes. Unparsable
    names are dropped in both modes.
    """
    y, m = name_month(name_col)
    sy, sm = (int(x) for x in start.split("-"))
    ey, em = (int(x) for x in end.split("-"))
    parsed = y.isNotNull() & m.isNotNull()
    if mode == "range":
        key = y * 100 + m
        keep = parsed & key.between(sy * 100 + sm, ey * 100 + em)
    elif mode == "as_written":
        keep = parsed & ~(((y == sy) & (m < sm)) | ((y == ey) & (m > em)))
    else:
        raise ValueError(mode)
    return df.filter(keep)


def filter_period(df: DataFrame, ts: str, cutoff: str | None = None, start: str | None = None,
                  inclusive_day: bool = False) -> DataFrame:
    """Parse ``ts`` to the wall clock, drop unparsable, keep ``start <= ts`` and
    ``ts <= cutoff`` (midnight rule) or the whole cutoff day with ``inclusive_day``."""
    t = wall_clock(ts)
    out = df.withColumn(ts, t).filter(F.col(ts).isNotNull())
    if start is not None:
        out = out.filter(F.col(ts) >= F.to_timestamp_ntz(F.lit(start)))
    if cutoff is not None:
        out = out.filter(cutoff_filter(ts, cutoff, inclusive_day))
    return out


def normalise_na(df: DataFrame, cols: Iterable[str], tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Turn pandas' missing-value tokens into null in the given string columns."""
    tokens = list(tokens)
    return df.withColumns({c: null_if_na(c, tokens) for c in cols})


def clean_comments(df: DataFrame, text: str = "comments", drop_null: Iterable[str] = ("comments",),
                   drop_blank: bool = True, na_tokens: Iterable[str] | None = None,
                   fill: Mapping[str, object] | None = None) -> DataFrame:
    """Optional null-token normalisation, drop nulls in ``drop_null`` (B3/B5), drop
    blank texts by the Python ``strip()`` rule (B4), then fill defaults (B6)."""
    out = df
    if na_tokens is not None:
        out = normalise_na(out, [text], na_tokens)
    drop_null = list(drop_null)
    if drop_null:
        out = out.na.drop(subset=drop_null)
    if drop_blank:
        out = out.filter(has_text(text))
    if fill:
        out = fill_default(out, fill)
    return out


def fill_default(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Explicit default fill, e.g. ``{'comments': 'No comment', 'score': 0}``."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})

"""Article bookkeeping: J4 article index, J6 press lookup, J7 day coverage
(A12, A13, B15-B18, C1, G4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- fixed values -------------------------------------------------------------------------
# Characters not allowed in a file title; each becomes "_".
UNSAFE_TITLE = r'[\\/*?:"<>|]'
# ------------------------------------------------------------------------------------------


def article_key(url: Column) -> tuple[Column, Column, Column]:
    """Drop the query string; last path part = article id, the one before = press id;
    object id ``news{press},{article}``. Short urls give null ids."""
    path = F.substring_index(url, "?", 1)
    parts = F.split(path, "/")
    n = F.size(parts)
    article = F.when(n >= 2, F.element_at(parts, -1))
    press = F.when(n >= 2, F.element_at(parts, -2))
    obj = F.concat(F.lit("news"), press, F.lit(","), article)
    return press, article, obj


def safe_title(title: Column) -> Column:
    """``\\ / * ? : " < > |`` -> ``_``."""
    return F.regexp_replace(title, UNSAFE_TITLE, "_")


def output_name(day: Column, press: Column, title: Column) -> Column:
    """``{date}_{press}_{title}.csv``."""
    return F.concat(F.concat_ws("_", day.cast("string"), press, safe_title(title)), F.lit(".csv"))


def article_index(df: DataFrame, url: str = "url", title: str = "title", day: str = "day",
                  order: str | None = None) -> DataFrame:
    """One row per article (object id): press id, article id, first day seen, title and
    output file name of its first copy (by ``order``, default ``day``), and the number of
    copies. Rows whose url has no two path parts are left out (see :func:`article_rejects`).
    One grouped aggregate with ``min_by``: partial per task, skew-safe."""
    press, article, obj = article_key(F.col(url))
    order = order or day
    rows = df.select(press.alias("press_id"), article.alias("article_id"), obj.alias("object_id"),
                     F.col(url).alias("url"), F.col(title).alias("title"), F.col(day).alias("day"),
                     F.col(order).alias("_ord")).filter(F.col("object_id").isNotNull())
    # Total order (order, url, title): the pick does not depend on task order or retries.
    first = F.min_by(F.struct("url", "title", "day"), F.struct("_ord", "url", "title"))
    agg = rows.groupBy("object_id", "press_id", "article_id").agg(
        first.alias("f"), F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n_copies"))
    return agg.select("object_id", "press_id", "article_id", "first_day", F.col("f.url").alias("url"),
                      safe_title(F.col("f.title")).alias("safe_title"),
                      output_name(F.col("f.day"), F.col("press_id"), F.col("f.title")).alias("file_name"),
                      "n_copies")


def article_rejects(df: DataFrame, url: str = "url") -> DataFrame:
    _, _, obj = article_key(F.col(url))
    return df.filter(obj.isNull())


def lookup_press(df: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str,
                 out: str = "press_name") -> DataFrame:
    """Left join id -> name; unmatched rows are kept with a null name. An id listed
    several times has its smallest name, so rows are never multiplied. Which side is broadcast,
    if any, is left to the planner."""
    d = dim.groupBy(F.col(dim_key).alias("_k")).agg(F.min(name).alias(out))
    return df.join(d, F.col(key) == F.col("_k"), "left").drop("_k")


def day_list(start: str, end: str, inclusive_end: bool = False) -> Column:
    """Every day from ``start`` up to ``end`` (exclusive by default, like the crawl loop)."""
    last = F.to_date(F.lit(end)) if inclusive_end else F.date_sub(F.to_date(F.lit(end)), 1)
    return F.sequence(F.to_date(F.lit(start)), last, F.expr("INTERVAL 1 DAY"))


def day_coverage(df: DataFrame, ts: str, by: str, start: str, end: str, inclusive_end: bool = True) -> DataFrame:
    """Rows per ``by`` x day for every day of the range, 0 for days without rows.

    The grid is generated per key with ``explode(sequence(...))`` from the distinct keys --
    no cross join. Counts are a grouped aggregate (partial per task)."""
    lo = F.to_date(F.lit(start))
    hi = F.to_date(F.lit(end)) if inclusive_end else F.date_sub(F.to_date(F.lit(end)), 1)
    rows = df.select(F.col(by).alias(by), F.to_date(F.col(ts)).alias("day")).filter(F.col(by).isNotNull())
    counts = (rows.filter((F.col("day") >= lo) & (F.col("day") <= hi))
                  .groupBy(by, "day").agg(F.count(F.lit(1)).alias("n_rows")))
    grid = rows.select(by).distinct().select(by, F.explode(day_list(start, end, inclusive_end)).alias("day"))
    return (grid.join(counts, [by, "day"], "left")
                .select(by, "day", F.coalesce("n_rows", F.lit(0)).alias("n_rows")))

"""J19 press groups.

The group map is caller data (a Python mapping ``group -> outlets``). It becomes a tiny
dimension frame built on the driver, whose size is known before any job runs, so it is
broadcast: the comment side is never shuffled for a group lookup.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.operators.joins import broadcast_local

OTHER = "other"


def group_table(spark: SparkSession, groups: Mapping[str, Iterable[str]], press: str = "press_name",
                first_wins: bool = True) -> DataFrame:
    """(press, group, group_pos) rows. With ``first_wins`` an outlet listed in two groups keeps
    the first one, as an if/elif chain over the groups does."""
    rows, seen = [], set()
    for pos, (g, members) in enumerate(groups.items()):
        for m in members:
            if first_wins and m in seen:
                continue
            seen.add(m)
            rows.append((m, g, pos))
    schema = f"`{press}` string, `group` string, group_pos int"
    return spark.createDataFrame(rows, schema)


def group_members(groups: Mapping[str, Iterable[str]]) -> list[str]:
    """The set union of all listed outlets, sorted."""
    return sorted({m for ms in groups.values() for m in ms})


def assign_group(df: DataFrame, groups: Mapping[str, Iterable[str]], press: str = "press_name",
                 other: str = OTHER, out: str = "group") -> DataFrame:
    """Add ``out`` = the outlet's group (first listed wins), ``other`` when unlisted.
    Spelling is not corrected: the map is matched as given (SURVEY T6)."""
    dim = group_table(df.sparkSession, groups, press).select(press, F.col("group").alias(out))
    return (df.join(broadcast_local(dim), press, "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(other))))


def expand_groups(df: DataFrame, groups: Mapping[str, Iterable[str]], press: str = "press_name",
                  other: str | None = OTHER, out: str = "group") -> DataFrame:
    """Membership semantics: a row appears once per group listing its outlet; rows of unlisted
    outlets go to ``other`` (or are dropped when ``other`` is None)."""
    dim = group_table(df.sparkSession, groups, press, first_wins=False).select(press, F.col("group").alias(out))
    joined = df.join(broadcast_local(dim), press, "left")
    if other is None:
        return joined.filter(F.col(out).isNotNull())
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(other)))


def filter_members(df: DataFrame, members: Iterable[str], press: str = "press_name") -> DataFrame:
    """Rows whose outlet is in ``members`` (an ``IN`` list: pushed to the scan)."""
    return df.filter(F.col(press).isin(list(members)))


def unlisted_outlets(df: DataFrame, groups: Mapping[str, Iterable[str]], press: str = "press_name") -> DataFrame:
    """Distinct outlets that appear in the data but in no group, sorted."""
    dim = group_table(df.sparkSession, groups, press).select(press)
    return (df.select(press).filter(F.col(press).isNotNull()).distinct()
              .join(broadcast_local(dim), press, "left_anti").orderBy(press))

"""Emotion shares: J21 summary conforming, J20 share of key total, J23 group x month mean
share with dense grid and stack offsets (B9, B11, C6, D10, D12, E1, E2, H1, H3).

Both operators run on the month x outlet SUMMARY (one row per key, duplicates rare), whose
size does not grow with the comment data. Each is one pass with one shuffle:

* J20 computes each row's total locally, then the key total with a window sum over the WIDE
  rows (a key's window partition holds only that key's duplicate rows), then unpivots. No
  self-join, so the summary's lineage (often an expensive join + aggregate) runs once.
* J23 is a single grouped aggregate per (group, month) with one conditional ``avg`` per
  emotion; the dense grid and the stack offsets are then generated per row with ``inline``
  (offsets are sums of the preceding means, built as column expressions). No grid join, no
  cross join, no window.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.operators.clean import require_columns
from pressroom.operators.groups import OTHER, expand_groups

KEY = "Year-Month-Media"

# --- fixed values -------------------------------------------------------------------------
# The seven emotion columns of the monthly summary, in chart order.
EMOTIONS = (
    "불평/불만(Complaints)",
    "화남/분노(Angry)",
    "짜증(Annoying)",
    "의심/불신(disbelief)",
    "증오/혐오(hate)",
    "한심함(patheticness)",
    "어이없음(Absurdity)-기타",
)
# ------------------------------------------------------------------------------------------


def build_summary(df: DataFrame, ts: str, outlet: str, values: Mapping[str, Column],
                  key: str = KEY) -> DataFrame:
    """Bridge from row data to the ``Year-Month-Media`` summary: one row per month x outlet
    with one aggregate column per entry of ``values`` (e.g. mean label scores)."""
    k = F.concat_ws("-", F.date_format(F.col(ts), "yyyy-MM"), F.col(outlet))
    return (df.filter(F.col(ts).isNotNull() & F.col(outlet).isNotNull())
              .groupBy(k.alias(key))
              .agg(*[agg.alias(name) for name, agg in values.items()]))


def summary_from_scores(scores: DataFrame, labels: Sequence[str], press: str = "press_name",
                        month: str = "month", key: str = KEY) -> DataFrame:
    """Bridge J17 -> J20: month-scope mean scores (one row per press x ``YYYY-MM`` month)
    become the ``Year-Month-Media`` summary that ``emotion_share`` reads."""
    k = F.concat_ws("-", F.col(month), F.col(press))
    return scores.select(k.alias(key), *[F.col(f"`{c}`") for c in labels])


def split_key(key: Column, zero_pad: bool = False) -> tuple[Column, Column]:
    """``Year-Month`` = first two ``-`` parts, ``Media_Outlet`` = the third one
    (an outlet holding ``-`` is cut there, as in the reference). Missing parts -> null."""
    parts = F.split(key, "-")
    y, m, media = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    if zero_pad:
        m = F.lpad(m, 2, "0")
    ym = F.when(y.isNotNull() & m.isNotNull(), F.concat_ws("-", y, m))
    return ym, media


def number(c: Column) -> Column:
    """Text to double; what is no number -- also ``NaN`` -- is null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def emotion_share(df: DataFrame, cols: Sequence[str] = EMOTIONS, key: str = KEY,
                  zero_pad: bool = False, sort: bool = False) -> DataFrame:
    """Keep the listed columns that exist (B7), text -> double with bad values -> 0
    (B9, B6), wide -> long (H1), total per key shared by duplicate keys (T5), share in %
    (0 when the total is 0, E1), and the split key (B11)."""
    present = require_columns(df, [key], cols)
    if not present:
        raise ValueError(f"none of the emotion columns {list(cols)} exist")
    wide = df.select(F.col(key), *[F.coalesce(number(F.col(c)), F.lit(0.0)).alias(c)
                                   for c in present])
    row_total = sum((F.col(c) for c in present[1:]), F.col(present[0]))
    wide = wide.withColumn("Group_Total_Score", F.sum(row_total).over(Window.partitionBy(key)))
    long = wide.unpivot([key, "Group_Total_Score"], present, "Emotion_Type", "Score")
    ym, media = split_key(F.col(key), zero_pad)
    out = long.select(
        key, "Emotion_Type", "Score", "Group_Total_Score",
        F.when(F.col("Group_Total_Score") == 0, F.lit(0.0))
         .otherwise(F.col("Score") / F.col("Group_Total_Score") * 100).alias("Ratio"),
        ym.alias("Year-Month"), media.alias("Media_Outlet"),
    )
    return out.orderBy("Year-Month") if sort else out


def conform_summary(df: DataFrame, cols: Sequence[str], key: str = KEY, zero_pad: bool = True) -> DataFrame:
    """Summary rows -> ``Year-Month`` (zero-padded month), ``Media_Outlet``, numeric
    columns; ``bad_key`` flags keys with fewer than three parts."""
    present = require_columns(df, [key], cols)
    ym, media = split_key(F.col(key), zero_pad)
    return df.select(
        key, ym.alias("Year-Month"), media.alias("Media_Outlet"),
        *[number(F.col(c)).alias(c) for c in present],
        (ym.isNull() | media.isNull()).alias("bad_key"),
    )


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that occur more than once (their rows share one total in J20)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def group_month_share(long: DataFrame, groups: Mapping[str, Iterable[str]],
                      order: Sequence[str] = EMOTIONS, other: str | None = OTHER,
                      zero_pad: bool = True, label_min: float = 5.0, places: int | None = 6) -> DataFrame:
    """Per press group x month x emotion the mean ``Ratio`` (D10) over the group's
    outlets, on a dense grid -- every month seen in the group times every emotion of
    ``order``, missing -> 0 (C6 / H3) -- with stack offsets ``start`` (running sum over the
    emotions before it), ``mid`` and a ``x.x%`` label where the share exceeds ``label_min``
    (E2). Months sort as zero-padded text (T26)."""
    rows = long.select(
        F.col("Media_Outlet").alias("press_name"), F.col("Emotion_Type"), F.col("Ratio"),
        (split_key(F.col(KEY), zero_pad)[0] if zero_pad else F.col("Year-Month")).alias("Year-Month"),
    ).filter(F.col("press_name").isNotNull() & F.col("Year-Month").isNotNull())
    rows = expand_groups(rows, groups, press="press_name", other=other, out="group")
    order = list(order)
    et = F.col("Emotion_Type")
    means = rows.groupBy("group", "Year-Month").agg(
        *[F.coalesce(F.avg(F.when(et == e, F.col("Ratio"))), F.lit(0.0)).alias(f"m{i}") for i, e in enumerate(order)])
    structs = []
    for i, e in enumerate(order):
        start = sum((F.col(f"m{j}") for j in range(1, i)), F.col("m0")) if i > 0 else F.lit(0.0)
        structs.append(F.struct(F.lit(i).alias("pos"), F.lit(e).alias("Emotion_Type"),
                                F.col(f"m{i}").alias("mean_ratio"), start.alias("start")))
    dense = means.select("group", "Year-Month", F.inline(F.array(*structs)))

    def r(c):
        return F.round(c, places) if places is not None else c

    return (dense.withColumn("mid", F.col("start") + F.col("mean_ratio") / 2)
                 .withColumn("label", F.when(F.col("mean_ratio") > label_min,
                                             F.format_string("%.1f%%", F.round("mean_ratio", 1))))
                 .select("group", "Year-Month", "pos", "Emotion_Type", r(F.col("mean_ratio")).alias("mean_ratio"),
                         r(F.col("start")).alias("start"), r(F.col("mid")).alias("mid"), "label"))

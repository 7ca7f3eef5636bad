"""Exact quantiles (linear interpolation, as pandas and Spark's ``percentile``) without
holding a group's values in one task.

Spark's exact ``percentile`` keeps a value -> count map per group and merges it in one task:
unbounded for a hot group of continuous values. Here each quantile is found by band refinement,
the same way for groups of all sizes:

1. one grouped aggregate: ``n``, min, max and ``percentile_approx`` at ``p - m`` and
   ``p + m`` for each wanted ``p`` (``m = margin / accuracy``) -- a bracket around the
   wanted ranks;
2. one pass keeps, per wanted quantile, the values inside its bracket counted per distinct
   value plus one counter of the rows below the bracket; this small result is checkpointed
   and each bracket verified (``#(v < lo) <= rank`` and ``#(v <= hi) > rank``); a bracket that
   fails (its two ranks lie further apart than the margin, or the sketch was off) is recounted
   over its group's whole range;
3. the in-bracket values are ranked by running sums over range partitions (``operators.running``),
   so a bracket of any size is spread over tasks; the rows holding the two ranks around
   ``p * (n - 1)`` give the interpolated value.

NaN counts as missing. The per-group tables (one row per group) are checkpointed and broadcast
behind a check of their bytes (``joins.bounded_broadcast``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.operators.joins import bounded_broadcast
from pressroom.operators.running import running_sums
from pressroom.session import cut_lineage

DEFAULT_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = DEFAULT_ACCURACY, margin: float = 4.0,
                    extra_aggs: Mapping[str, Column] | None = None, out_prefix: str = "q") -> DataFrame:
    """One row per group: ``by``, ``n`` (values that are no null and no NaN), the ``extra_aggs``
    (expressions over the column ``_v``) and ``{out_prefix}{i}`` = the exact ``probs[i]`` quantile.
    Groups without a value (or with a null key) are absent."""
    by = list(by)
    probs = [float(p) for p in probs]
    v = F.col("_v")
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    for k in by:
        data = data.filter(F.col(k).isNotNull())
    return _band_quantiles(data, by, probs, accuracy, margin, extra_aggs, out_prefix)


def _band_quantiles(data: DataFrame, by: list[str], probs: list[float], accuracy: int, margin: float,
                    extra_aggs, out_prefix: str) -> DataFrame:
    m = margin / accuracy
    pcts = []
    for p in probs:
        pcts += [max(0.0, p - m), min(1.0, p + m)]
    v = F.col("_v")

    # 1. counts and approximate brackets, one row per group
    stats = data.groupBy(*by).agg(
        F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.percentile_approx(v, pcts, accuracy).alias("_ap"),
        *[e.alias(k) for k, e in (extra_aggs or {}).items()])
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        cols += [pos.alias(f"_pos{i}"), F.floor(pos).alias(f"_rl{i}"), F.ceil(pos).alias(f"_rh{i}"),
                 F.col("_ap")[2 * i].alias(f"_lo{i}"), F.col("_ap")[2 * i + 1].alias(f"_hi{i}")]
    stats = stats.select("*", *cols).drop("_ap")
    stats_b, _ = bounded_broadcast(stats)
    k = list(range(len(probs)))

    # 2. one pass: per target, the in-bracket values counted per distinct value plus ONE
    #    "below the bracket" counter (partial aggregation folds those rows to one per task).
    #    The result is bounded by the bracket sizes; it is checkpointed and verified.
    def band_counts(src: DataFrame, brackets: DataFrame) -> DataFrame:
        j = src.join(brackets.select(*by, *[c for i in k for c in (f"_lo{i}", f"_hi{i}")]), by)
        elems = [F.when(v <= F.col(f"_hi{i}"),
                        F.struct(F.lit(i).alias("_i"), (v < F.col(f"_lo{i}")).alias("_below"),
                                 F.when(v >= F.col(f"_lo{i}"), v).alias("_bv")))
                 for i in k]
        return (j.select(*by, F.explode(F.array(*elems)).alias("_e")).filter(F.col("_e").isNotNull())
                 .select(*by, "_e.*").groupBy(*by, "_i", "_below", "_bv").agg(F.count(F.lit(1)).alias("_c")))

    counts = cut_lineage(band_counts(data, stats_b))
    ranks = stats_b.select(*by, F.array(*[F.col(f"_rl{i}") for i in k]).alias("_rls"),
                           F.array(*[F.col(f"_rh{i}") for i in k]).alias("_rhs"))
    rl, rh = F.element_at("_rls", F.col("_i") + 1), F.element_at("_rhs", F.col("_i") + 1)
    check = (counts.groupBy(*by, "_i")
                   .agg(F.coalesce(F.sum(F.when(F.col("_below"), F.col("_c"))), F.lit(0)).alias("_below_n"),
                        F.sum("_c").alias("_le_n"))
                   .join(ranks, by))
    failed = check.filter(~((F.col("_below_n") <= rl) & (F.col("_le_n") > rh))).select(*by, "_i")
    if failed.count():
        # recount those (group, target) pairs over the group's whole range
        whole = stats_b.select(*by, *[c for i in k for c in (F.col("_min").alias(f"_lo{i}"),
                                                             F.col("_max").alias(f"_hi{i}"))])
        redo = band_counts(data.join(failed.select(*by).distinct(), by, "left_semi"), whole) \
            .join(failed, by + ["_i"], "left_semi")
        counts = counts.join(failed, by + ["_i"], "left_anti").unionByName(redo)

    # 3. rank the in-bracket values; base = rows below the bracket
    bases = counts.filter(F.col("_below")).groupBy(*by, "_i").agg(F.sum("_c").alias("_base"))
    vals = counts.filter(~F.col("_below")).select(*by, "_i", "_bv", "_c")
    ranked = (running_sums(vals, {"_cum": F.col("_c")}, ["_bv"], keys=[*by, "_i"])
                  .join(bases, by + ["_i"], "left").join(ranks, by))
    base = F.coalesce(F.col("_base"), F.lit(0))
    first_rank = base + F.col("_cum") - F.col("_c")
    last_rank = base + F.col("_cum") - 1
    picked = ranked.groupBy(*by).agg(*[c for i in k for c in (
        F.max(F.when((F.col("_i") == i) & (first_rank <= rl) & (rl <= last_rank), F.col("_bv"))).alias(f"_xl{i}"),
        F.max(F.when((F.col("_i") == i) & (first_rank <= rh) & (rh <= last_rank), F.col("_bv"))).alias(f"_xh{i}"))])

    out = stats_b.join(picked, by)
    results = []
    for i in k:
        pos, lo_r, hi_r = F.col(f"_pos{i}"), F.col(f"_rl{i}"), F.col(f"_rh{i}")
        xl, xh = F.col(f"_xl{i}"), F.col(f"_xh{i}")
        results.append(F.when(lo_r == hi_r, xl).otherwise((hi_r - pos) * xl + (pos - lo_r) * xh)
                        .alias(f"{out_prefix}{i}"))
    return out.select(*by, F.col("_n").alias("n"), *list(extra_aggs or {}), *results)

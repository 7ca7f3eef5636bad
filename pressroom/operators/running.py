"""Exact running sums without one task per partition key (used by J8, J17 and the quantiles).

``Window.partitionBy(keys).orderBy(order)`` puts every row of a key into one task; with a hot
key (a third of the rows) that task sorts a third of the data. Here the rows are range-partitioned
by ``(keys, order)``, so the parallelism follows the data, whatever the keys or their time span:

1. the range-partitioned rows are checkpointed with their partition number (the bounds are sampled,
   so they must not be drawn again);
2. a grouped aggregate gives the total per (partition, key), and a window over these -- one row per
   partition and key in it -- the sum of all earlier partitions of the key;
3. a row's running sum is that offset plus the running sum within its partition and key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.session import cut_lineage


def running_sums(df: DataFrame, values: Mapping[str, Column], order: Sequence[Column | str],
                 keys: Sequence[str] = ()) -> DataFrame:
    """Adds one running-sum column (rows from the first up to the current one, in ``order``)
    per entry of ``values``, restarting for every combination of ``keys`` (null is a key)."""
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = list(values)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    rows = cut_lineage(rows.repartitionByRange(parts, *keys, *order_cols).withColumn("_p", F.spark_partition_id()))
    part = ["_p", *keys]
    totals = rows.groupBy(*part).agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.sum(f"_t{i}").over(earlier).alias(f"_o{i}") for i in range(len(names))])
    within = Window.partitionBy("_jk", *part).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One shuffle for the offsets and the window: both go by a surrogate of (partition, key); the
    # keys themselves are compared as a residual condition.
    rows = rows.withColumn("_jk", F.xxhash64(*part))
    names_o = {c: f"_right_{c}" for c in part}
    offsets = offsets.withColumn("_right_jk", F.xxhash64(*part)).withColumnsRenamed(names_o)
    cond = F.col("_jk") == F.col("_right_jk")
    for c in part:
        a, b = F.col(f"`{c}`"), F.col(f"`{names_o[c]}`")
        cond = cond & F.coalesce(a == b, a.isNull() & b.isNull())
    joined = rows.join(offsets, cond).drop("_right_jk", *names_o.values())

    def running(i: int) -> Column:  # null while there was no value at all
        before, here = F.col(f"_o{i}"), F.sum(f"_v{i}").over(within)
        return F.coalesce(before + here, before, here)

    out = joined.withColumns({n: running(i) for i, n in enumerate(names)})
    return out.drop("_p", "_jk", *[f"{c}{i}" for c in ("_v", "_o") for i in range(len(names))])

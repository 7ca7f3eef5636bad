"""J11 column profile, null audit and first/last rows.

``profile`` unpivots the numeric columns and computes every statistic per column as a
group: count, mean, std, min, max in one partial aggregate; quartiles exact by band
refinement (linear interpolation like pandas, no task holds a whole column) or, with
``exact=False``, by ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.operators.quantiles import DEFAULT_ACCURACY, exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def not_nan(c: Column) -> Column:
    """As double, NaN as null: pandas counts neither."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def profile(df: DataFrame, cols: Iterable[str] | None = None, exact: bool = True,
            accuracy: int = DEFAULT_ACCURACY, places: int | None = 6) -> DataFrame:
    """One row per numeric column: count, mean, std, min, p25, p50, p75, max (pandas
    ``describe``). Floats are rounded to ``places`` when given.

    The columns are unpivoted to ``(column_name, value)`` and profiled as groups, so all
    columns share the same passes; exact quartiles use band refinement
    (``operators.quantiles``), ``exact=False`` the ``percentile_approx`` sketch."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = df.select(*[not_nan(F.col(c)).alias(c) for c in cols]).unpivot([], cols, "column_name", "_val")
    extra = {"mean": F.avg("_v"), "std": F.stddev_samp("_v"), "min": F.min("_v"), "max": F.max("_v")}
    if exact:
        st = exact_quantiles(long, ["column_name"], "_val", [0.25, 0.5, 0.75], accuracy, extra_aggs=extra)
    else:
        v = F.col("_val")
        st = (long.filter(v.isNotNull()).withColumn("_v", v).groupBy("column_name")
                  .agg(F.count(v).alias("n"), *[e.alias(k) for k, e in extra.items()],
                       F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_q"))
                  .select("column_name", "n", *extra, *[F.col("_q")[i].alias(f"q{i}") for i in range(3)]))
    # Columns without any value still get a row (count 0), as in pandas.
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "column_name string, _pos int")
    st = F.broadcast(names).join(st, "column_name", "left")

    def r(col: Column) -> Column:
        return F.round(col, places) if places is not None else col

    return st.select("column_name", F.coalesce("n", F.lit(0)).alias("count"), r(F.col("mean")).alias("mean"),
                     r(F.col("std")).alias("std"), "min", r(F.col("q0")).alias("p25"), r(F.col("q1")).alias("p50"),
                     r(F.col("q2")).alias("p75"), "max")


def column_info(df: DataFrame) -> DataFrame:
    """pandas ``info()``: one row per column with its type name and non-null count."""
    fields = df.schema.fields
    wide = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.col(f"c{i}").alias("non_null"))
               for i, f in enumerate(fields)]
    return wide.select(F.inline(F.array(*structs)))


def null_audit(df: DataFrame, cond: Column | None, cols: Iterable[str]) -> DataFrame:
    """Rows matching ``cond``, then the number of nulls in each of ``cols`` (long form)."""
    cols = list(cols)
    sub = df if cond is None else df.filter(cond)
    wide = sub.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null"))
        for i, c in enumerate(cols)])))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """first ``n`` rows by an explicit key (a distributed TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """last ``n`` rows by an explicit key."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)

"""J2 article sink: first fetch per key wins, keys already in the sink are skipped
(A7, A8, A9, C2, G5).

``first_fetch`` keeps, per output key, all rows of the earliest fetch (a grouped ``min`` of
the fetch order joined back -- no per-key window, so a hot key costs a partial aggregate).
``write_new_articles`` then drops keys the sink already holds (``left_anti`` against the
sink's key columns, which Catalyst prunes to a key-only scan) and appends partitioned files.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pressroom.operators.joins import join_keys

# Default output key of an article file: (date, press, sanitised title) -- SURVEY T20.
DEFAULT_KEY = ("date", "press_name", "title")


def first_fetch(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of the first fetch (smallest ``order``) of each key. A null in the key is a
    value like any other; a null ``order`` comes last (a key with nothing else keeps its rows)."""
    key = list(key)
    firsts = df.groupBy(*key).agg(F.min(order).alias("_first"))
    return (join_keys(df, firsts, key).filter(F.col(order).eqNullSafe(F.col("_first"))).drop("_first"))


def _exists(spark, path: str) -> bool:
    """Whether the path exists where Spark would write it (the Hadoop file system of the path,
    by default ``fs.defaultFS``)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Cells keep their outer white space, quotes are doubled.
CSV_WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_READ = {"header": True, "escape": '"', "multiLine": True}


def new_articles(df: DataFrame, path: str, key: Sequence[str] = DEFAULT_KEY, order: str = "fetch_seq",
                 fmt: str = "parquet", prune_by: Sequence[str] = (), except_batch: int | None = None) -> DataFrame:
    """First-fetch rows whose key is not in the sink at ``path`` yet (null equals null).

    ``prune_by``: sink partition columns that are part of the key. The batch's smallest and largest
    value of each (two values, whatever the batch) become a partition filter, so only folders within
    that span are read. ``except_batch`` (streams): the sink has a ``batch_id`` column;
    rows of this batch do not count as present (a replay writes them anew), and rows of a key
    whose stored fetch has the same ``order`` are the rest of an article that came in several
    batches: they are taken unless the same row is stored already."""
    key = list(key)
    fresh = first_fetch(df, key, order)
    spark = df.sparkSession
    if not _exists(spark, path):
        return fresh
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV_READ)
    sink_df = reader.load(path)
    if except_batch is not None:
        sink_df = sink_df.filter(F.col("batch_id") != except_batch)
    folders = [c for c in prune_by if c in key]
    if folders:
        # Partition discovery may type a folder value (e.g. a date); compare as the sink's types.
        own = {c: F.col(c).cast(sink_df.schema[c].dataType) for c in folders}
        span = df.agg(*[f(own[c]).alias(f"{name}{i}") for i, c in enumerate(folders)
                        for name, f in (("lo", F.min), ("hi", F.max), ("none", lambda x: F.max(x.isNull())))]).first()
        for i, c in enumerate(folders):
            inside = F.col(c).between(F.lit(span[f"lo{i}"]), F.lit(span[f"hi{i}"])) if span[f"lo{i}"] is not None else F.lit(False)
            sink_df = sink_df.filter(inside | F.col(c).isNull() if span[f"none{i}"] else inside)
    stored = sink_df.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in (df.columns if except_batch is not None else key)])
    if except_batch is None:
        return join_keys(fresh, stored.distinct(), key, "left_anti")
    known = stored.groupBy(*key).agg(F.min(order).alias("_stored"))
    rest = join_keys(fresh, known, key, "left").filter(F.col("_stored").isNull() | F.col("_stored").eqNullSafe(F.col(order)))
    same = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    stored_rows = stored.select(*key, same.alias("_row")).distinct()
    return join_keys(rest.withColumn("_row", same), stored_rows, [*key, "_row"], "left_anti").select(*df.columns)


def write_new_articles(df: DataFrame, path: str, key: Sequence[str] = DEFAULT_KEY, order: str = "fetch_seq",
                       partition_by: Sequence[str] = ("press_name", "date"), fmt: str = "parquet") -> int:
    """Append the new articles partitioned by press and date; returns rows written.

    The new rows are checkpointed first so the anti-join against the sink is evaluated once
    -- before the append changes the sink -- and the count and the write see the same rows."""
    from pressroom.session import cut_lineage

    fresh = cut_lineage(new_articles(df, path, key, order, fmt, prune_by=partition_by))
    n = fresh.count()
    if n:
        w = rebalance_for_write(fresh, partition_by).write.mode("append").partitionBy(*partition_by).format(fmt)
        if fmt == "csv":
            w = w.options(**CSV_WRITE)
        w.save(path)
    return n


def rebalance_for_write(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``REBALANCE`` hint on the folder columns: AQE shuffles rows so each task writes whole
    folders (few files per folder) and splits a hot folder over several tasks."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def write_press_tables(df: DataFrame, path: str, presses: DataFrame | None = None, press: str = "press_name") -> None:
    """One table per press in one folder each. Only the presses of this run are replaced -- those
    with rows in ``df`` and those listed in ``presses`` (a column ``press``) -- all others stay as
    they are (dynamic partition overwrite, so a run that fails replaces none). A listed press without
    rows keeps an empty table: a row of nulls marked ``_scored = false`` stands for it."""
    rows = df.withColumn("_scored", F.lit(True))
    if presses is not None:
        have = df.select(F.col(press).alias("_have")).distinct()
        empty = presses.select(press).distinct().join(have, F.col(press).eqNullSafe(F.col("_have")), "left_anti")
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in df.schema.fields if f.name != press}
        rows = rows.unionByName(empty.withColumns(nothing).withColumn("_scored", F.lit(False)))
    (rebalance_for_write(rows, [press]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(press).parquet(path))


def _with_names(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    """A partitioned table whose folder values are read as the strings they are, not as what they look
    like (a press may be called 023)."""
    found = spark.read.parquet(path).schema
    typed = StructType([StructField(f.name, StringType()) if f.name in folders else f for f in found])
    return spark.read.schema(typed).parquet(path)


def read_press_tables(spark: SparkSession, path: str, press: str = "press_name") -> tuple[DataFrame, DataFrame]:
    """Returns (rows of all press tables, list of presses): a press without rows is in the list only."""
    stored = _with_names(spark, path, [press])
    return stored.filter("_scored").drop("_scored"), stored.select(press).distinct()


def read_listed(spark: SparkSession, path: str, listed: DataFrame, folders: Mapping[str, Column | str]) -> DataFrame:
    """A5: the rows of a partitioned table whose folders a list names. ``folders``: for every column of
    ``listed`` to join on, the table's folder column (or an expression of folder columns). The list
    stays a table: its values reach the scan as dynamic partition pruning, no path is made of them on
    the driver. Spark prunes that way when the list is filtered, or small enough to be broadcast."""
    table = _with_names(spark, path, [f for f in folders.values() if isinstance(f, str)])
    names = {c: f"_listed_{c}" for c in folders}
    side = listed.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    keys = [(F.col(f) if isinstance(f, str) else f) == F.col(names[c]) for c, f in folders.items()]
    return table.join(side, reduce(lambda a, b: a & b, keys), "left_semi")


# ---------------------------------------------------------------- one file
def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, p, p.getFileSystem(conf), conf


def write_merged_csv(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """All rows as one CSV file with one header, in ``order``; what was at ``path`` is replaced.

    Rows are range-partitioned and sorted by ``order``, every task writes its range, and the commit
    joins the range files under the header: by the file system's ``concat`` where it has one (HDFS:
    no byte is copied), else by one sequential copy through a buffer, which is what a single file on
    such a file system takes. The file appears under its name only when it is whole. Cells are quoted
    throughout; null and empty are the same cell."""
    from pressroom.session import scratch_path

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = scratch_path(spark, "merged-csv")
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    (dealt.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
     .write.options(**CSV_WRITE | {"header": False, "quoteAll": True, "emptyValue": "", "lineSep": "\n"}).csv(ranges))
    jvm, target, fs, conf = _hadoop(spark, path)
    _, source, source_fs, _ = _hadoop(spark, ranges)
    names = sorted(f.getPath().getName() for f in source_fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    whole = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex[:12]}")
    header = io.StringIO(newline="")
    csv.writer(header, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(df.columns)
    out = fs.create(whole, True)
    out.write(bytearray(header.getvalue().encode()))
    files = [jvm.org.apache.hadoop.fs.Path(source, n) for n in names]
    if fs.getScheme() == source_fs.getScheme() == "hdfs":
        out.close()
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(files))
        for i, f in enumerate(files):
            array[i] = f
        if files:
            fs.concat(whole, array)
    else:
        for f in files:
            part = source_fs.open(f)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.close()
    fs.delete(target, True)
    fs.rename(whole, target)


# Renames of article files under way at once.
RENAMES = 8


def write_article_files(files: DataFrame, root: str) -> None:
    """A7, the raw layout: files (press_name, file_name, content binary) as ``<root>/<press>/<file>``,
    through Spark's writer and the session's file system. A file's bytes are its content and a line
    end. Tasks write under folders of their own, the commit renames (no byte is copied)."""
    from pressroom.session import scratch_path

    spark = files.sparkSession
    staged = scratch_path(spark, "article-files")
    (files.select("press_name", "file_name", F.col("content").cast("string").alias("value"))
     .write.partitionBy("press_name", "file_name").text(staged))
    jvm, source, staging, _ = _hadoop(spark, staged)
    _, target, fs, _ = _hadoop(spark, root)
    hadoop = jvm.org.apache.hadoop
    value = lambda folder: _unescaped(folder.split("=", 1)[1])
    staged_as = lambda glob: hadoop.fs.FileUtil.stat2Paths(staging.globStatus(hadoop.fs.Path(source, glob)))
    for press in staged_as("press_name=*"):
        fs.mkdirs(hadoop.fs.Path(target, value(press.getName())))

    def rename(part) -> None:
        press, name = part.toString().split("/")[-3:-1]
        fs.rename(part, hadoop.fs.Path(f"{target.toString()}/{value(press)}/{value(name)}"))

    # all staged files listed in one call; those that move them wait on the file system, so several are under way
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(rename, staged_as("press_name=*/file_name=*/part-*")))


def _unescaped(folder: str) -> str:
    """The value of a folder as Spark's writer escapes it."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), folder)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Overwrite a whole result table (optionally one folder per press); see
    :func:`write_press_tables` for replacing some presses only."""
    w = rebalance_for_write(df, partition_by).write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.options(**CSV_WRITE)
    w.save(path)

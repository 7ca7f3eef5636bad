"""Bloom filters of a sink's keys, one per folder, kept beside the data.

A run that adds articles has to know which keys the sink holds. Where the folders are not part of the
key (a sink by day of fetch, keys by address), any folder may hold any key and an anti-join would read
the keys of them all. Here every append first writes what it adds to ``<sink>/_keys``, a table that
Spark does not take for data: blocks of 512 bits (eight words, one bit of each set by a key), by folder
and level (a folder's part of an append with 2^level blocks, about eight keys to a block; only blocks
with keys are rows). A run then reads the folders with a block that covers one of its keys and verifies
their keys exactly, so a false hit costs a folder's read and changes no result.

All of it is DataFrame work: the blocks are grouped ``bit_or``s (partially aggregated, so a hot folder
is one partial row per block and task), a folder is found by a left semi join of the blocks with the
run's keys on (level, block) and the covering test, and the folders found reach the scan as dynamic
partition pruning. Levels begin at ``LEAST``, so that a block number is shared by few of a run's keys.

Filters are written before their data: a run that fails in between leaves bits without keys, never
keys without bits. Every append to the sink has to go through :func:`write_filtered`; a sink that has no
filter yet gets one over all its rows.

Defined results: a null in a key is a value like any other; a null ``order`` comes last; rows with a
null folder value are read in every run; an empty batch adds nothing; of repeated rows of a key's first
fetch all stay.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.operators.joins import bounded_broadcast, join_keys
from pressroom.session import cut_lineage
from pressroom.sources import sink

FOLDER = "_keys"
WORDS = 8  # of 64 bits to a block
KEYS = 8  # to a block, about: a false hit is then a matter of some 10^-7 a key and folder
LEAST = 12  # smallest level
SEED = 42


def _plain(name: str, kind: T.DataType) -> Column:
    """A key column as a string that is the same in every session for values that a join holds equal."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c.cast("double") + F.lit(0.0)  # -0.0 is 0.0
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def key_hash(key: Sequence[str], kinds: Mapping[str, T.DataType]) -> Column:
    return F.xxhash64(*[_plain(k, kinds[k]) for k in key])


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _masks(hashed: str) -> list[Column]:
    """One bit of every word, by six bits each of a second hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({hashed}, {SEED}), {6 * i}) & 63 AS int))").alias(f"w{i}") for i in range(WORDS)]


def _block(hashed: str, level: str) -> Column:
    """The number of a key's block: the lowest bits of its hash."""
    return F.col(hashed).bitwiseAND(F.expr(f"shiftleft(1L, {level}) - 1")).alias("block")


def blocks(rows: DataFrame, key: Sequence[str], folders: Sequence[str]) -> DataFrame:
    """Filter rows of what ``rows`` adds: the folder columns (strings), level, block and its words."""
    names = {c: f"_folder_{i}" for i, c in enumerate(folders)}
    kinds = _kinds(rows)
    keys = rows.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in names.items()], key_hash(key, kinds).alias("_hash")).distinct()
    sizes = keys.groupBy(*names.values()).agg(F.greatest(F.lit(LEAST), F.ceil(F.log2(F.count(F.lit(1)) / KEYS)).cast("int")).alias("level"))
    sized = join_keys(keys, sizes, list(names.values()), "inner")
    words = [f"w{i}" for i in range(WORDS)]
    return (sized.select(*names.values(), "level", _block("_hash", "level"), *_masks("_hash"))
            .groupBy(*names.values(), "level", "block").agg(*[F.bit_or(w).alias(w) for w in words]))


def _write_blocks(rows: DataFrame, path: str, key: Sequence[str], folders: Sequence[str]) -> None:
    blocks(rows, key, folders).withColumn("key", F.lit("\n".join(key))).write.mode("append").parquet(os.path.join(path, FOLDER))


def folders_that_may_hold(batch: DataFrame, path: str, key: Sequence[str], folders: Sequence[str]) -> DataFrame:
    """The folders (columns ``folders``, strings) of the sink at ``path`` with a block that covers a key of
    ``batch``: at most one row each, whatever the number of keys."""
    spark = batch.sparkSession
    stored = spark.read.parquet(os.path.join(path, FOLDER))
    other = stored.filter(F.col("key") != "\n".join(key)).select("key").limit(1).collect()
    if other:
        raise ValueError(f"the sink's filter is over another key: {other[0]['key'].split()}")
    levels = [r["level"] for r in stored.select("level").distinct().collect()]  # numbers up to 60: a few
    wanted = batch.select(key_hash(key, _kinds(batch)).alias("_hash")).distinct()
    probes = (wanted.select("_hash", F.explode(F.array(*[F.lit(x).cast("int") for x in sorted(levels)])).alias("level"))
              .select("level", _block("_hash", "level"), *[m.alias(f"m{i}") for i, m in enumerate(_masks("_hash"))]))
    covers = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0 for i in range(WORDS)])
    probes = probes.withColumnsRenamed({"level": "_level", "block": "_block"})
    on = (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block")) & covers
    found = stored.join(probes, on, "left_semi")
    return found.select(*[F.col(f"_folder_{i}").alias(c) for i, c in enumerate(folders)]).distinct()


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.options(**sink.CSV_READ) if fmt == "csv" else reader).load(path)


def new_by_filter(df: DataFrame, path: str, key: Sequence[str], order: str, folders: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """First-fetch rows of ``df`` whose key the sink does not hold, as :func:`sink.new_articles` finds them,
    reading only the folders that the filters name."""
    key, folders, spark = list(key), list(folders), df.sparkSession
    fresh = cut_lineage(sink.first_fetch(df, key, order))  # probed and joined: computed once
    if not sink._exists(spark, path):
        return fresh
    table = _read(spark, path, fmt)
    if not sink._exists(spark, os.path.join(path, FOLDER)):
        _write_blocks(table.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in dict.fromkeys([*key, *folders])]), path, key, folders)
    hits = folders_that_may_hold(fresh, path, key, folders)
    side, _ = bounded_broadcast(hits.select(*[F.col(c).alias(f"_hit_{c}") for c in folders]))
    # True of every text: the planner prunes by a side that has a comparison, not by one that is merely not null.
    side = side.filter(F.col(f"_hit_{folders[0]}") >= "")
    # Partition discovery may type a folder value (a date, a number); the filters hold the sink's own text of it.
    same = [F.col(c) == F.col(f"_hit_{c}").try_cast(table.schema[c].dataType) for c in folders]
    unnamed = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in folders])
    columns = [F.col(c).cast(df.schema[c].dataType).alias(c) for c in key]
    stored = (table.join(side, reduce(lambda a, b: a & b, same), "left_semi").select(*columns)
              .unionAll(table.filter(unnamed).select(*columns)))
    return join_keys(fresh, stored.distinct(), key, "left_anti")


def write_filtered(df: DataFrame, path: str, key: Sequence[str], order: str, folders: Sequence[str], fmt: str = "parquet") -> int:
    """Append the rows of new keys in folders by ``folders``, their filter first; returns rows written."""
    fresh = cut_lineage(new_by_filter(df, path, key, order, folders, fmt))
    n = fresh.count()
    if n:
        _write_blocks(fresh, path, key, folders)
        w = sink.rebalance_for_write(fresh, folders).write.mode("append").partitionBy(*folders).format(fmt)
        (w.options(**sink.CSV_WRITE) if fmt == "csv" else w).save(path)
    return n

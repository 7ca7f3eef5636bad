"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in (doc_id, content) order: one range partitioning, rows counted per partition,
numbers offset by the counts before. The permutation of 0 .. N-1 is a keyed Feistel network on the
next even power of two, repeated until the value falls below N; row i goes to position P(i), and
position p is slot ``p // shards`` of shard ``p % shards``. So shard sizes differ by at most one
row (law ``rows``), the order is reproducible from the seed, and both directions can be computed:
:func:`place_of` gives shard and slot of a row number, :func:`row_at` the row of a slot.

Law ``rows`` takes every row for itself: equal texts are not kept together, as a group with a
third of all rows could not be.

Defined results: null text counts as empty, null doc_id comes first, repeated rows get numbers of
their own, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pressroom.llm.common import U64, mix64, parallelism, written

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask = U64((1 << half) - 1)
    left, right = x >> U64(half), x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = U64((seed * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93 + 1) % 2**64)
        if back:
            left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << U64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0 .. n-1 (``back``: its inverse), for an array of numbers."""
    half = _half_bits(n)
    out = np.asarray(rows).astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], half, seed, back)
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def place_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    at = int(permute(np.array([row]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, n_rows): size is the UTF-8 bytes of the text plus 8."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(docs.select("doc_id", (F.length(text) + 8).cast("long").alias("size"),
                               F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_at")), "shard-rows")
    order = ["doc_id", "text_crc32", "size", "_at"]
    dealt = rows.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt = written(dealt.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("_part"),
                                 F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_part")), "shard-numbers")
    # one row per range partition, whatever the rows
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    return dealt.join(F.broadcast(before), "_part").select(
        "doc_id", "size", "text_crc32", (F.col("_before") + F.col("_in_part")).alias("row_number"), "n_rows")


def shard(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, row_number, law, shard, slot,
    grown_shard (null: under this law another shard moves rows between all)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = number_rows(docs)
    fields = ("doc_id", "size", "text_crc32", "row_number")
    schema = StructType([*(rows.schema[c] for c in fields), StructField("shard", IntegerType()), StructField("slot", LongType())])

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                at = permute(part.column("row_number").to_numpy(), part.column("n_rows")[0].as_py(), seed)
                columns = [*(part.column(c) for c in fields), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
                yield pa.RecordBatch.from_arrays(columns, names=[*fields, "shard", "slot"])

    placed = rows.mapInArrow(place, schema)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")

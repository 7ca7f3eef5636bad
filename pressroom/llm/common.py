"""Helpers shared by the operators of this subpackage: tables written to the shared folder,
and vectorised hashing of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pressroom.session import scratch_path

U64 = np.uint64
WORDS = 5  # words of a shingle


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: lineage is
    cut there, and a lost executor only repeats what it was running. ``session.drop_scratch``
    deletes the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the count that grows with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply-xorshift)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def byte_table(seed: int, lower: bool = True) -> np.ndarray:
    """A random value per byte; ``lower`` gives A-Z the values of a-z."""
    t = random64(256, seed)
    if lower:
        t[65:91] = t[97:123]
    return t


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.ones(256, bool)  # separators of bare words: everything but ASCII letters, digits and non-ASCII bytes
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column, one after the other, and the n + 1
    offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]] if len(off) else np.zeros(0, np.uint8), off - off[0]


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds about ``max_bytes`` of text (one row at least)."""
    if not batch.num_rows:
        return
    _, off = flat_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def words_of(data: np.ndarray, off: np.ndarray, table: np.ndarray, separator: np.ndarray = SPACE,
             ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and for each text the place of its first word (n + 1 places)."""
    n = len(off) - 1
    word = ~separator[data]
    if not len(data) or not word.any():
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = off[:-1][off[:-1] < len(data)]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    place = np.zeros(len(data), np.int64)
    place[starts[0]:] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15 | 1, U64))
    value = table[data] * powers[place]
    value[~word] = 0
    hashes = mix64(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, off)


def shingles_of(hashes: np.ndarray, at: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; a text of fewer words has
    its whole sequence as one shingle, a text without words none."""
    powers = np.cumprod(np.full(width, 0xD6E8FEB86659FD93, U64))
    total = np.zeros(max(0, len(hashes) - width + 1), U64)
    for j in range(width):
        total += hashes[j: j + len(total)] * powers[j]
    total = mix64(total + U64(width))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(total[a: b - width + 1]))
        elif b > a:
            out.append(mix64((hashes[a:b] * powers[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def blocks_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of one part after the other, of rows (part, block) that are sorted by part."""
    now, blocks = None, []
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
            if part != now and blocks:
                yield blocks
                blocks = []
            now = part
            blocks.append(block.as_py())
    if blocks:
        yield blocks


def dealt_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (part, block) dealt out by part, sorted for :func:`blocks_by_part`."""
    return rows.repartition(parts, "part").sortWithinPartitions("part")


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it (the first does)."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(U64)

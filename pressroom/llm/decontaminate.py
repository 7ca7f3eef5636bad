"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are what stands between ASCII white space, A-Z lower-cased; a text's set holds its distinct
5-word shingles (a text of one to four words: its whole sequence). A document is contaminated by an
item when at least ``threshold`` of the item's shingles are in the document.

MinHash signatures of whole documents would not find a short item in a long document, as their
Jaccard similarity is close to zero. So the sketch is of the item: its k smallest shingle hashes,
and a document is a candidate if it holds any of them. Items are partitioned by size (powers of
two); k of a partition follows from its largest size u, k = floor((1 - threshold) * u) + 1. An item
that lacks no more than (1 - threshold) of its shingles in a document then has at least one sketch
value there, so the search misses nothing; documents smaller than the item needs are passed over
by size. Candidates are verified by counting the item's shingles in the document's set.

So defined, an item of one to four words is found in documents that are just that, but not in longer
ones. With ``short_items`` it is also found where its words stand in a row in a longer document.

The items are a query set: they are taken in blocks of ``block_items``, each of which is broadcast
and run over all documents, so what is broadcast has that bound whatever the number of items.

Defined results: null and empty texts have no shingles and match nothing; repeated rows match
like the first; items with the same text match alike; a hash stands for a shingle in 64 bits;
an empty table on either side gives no rows; other columns are ignored (pairs) or kept (filter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import WORDS, byte_table, flat_bytes, shingles_of, signed, text_slices, unsigned, words_of, written

SEED = 61


def sketch_length(shingles: int, threshold: float) -> int:
    """k of the size partition that an item of so many shingles falls into."""
    largest = (1 << shingles.bit_length()) - 1
    return math.floor((1 - threshold) * largest + 1e-9) + 1


def need(shingles: int, threshold: float) -> int:
    return math.ceil(threshold * shingles - 1e-9)


class ItemIndex:
    """Sketches and sets of a block of items, as sorted arrays."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.ids = [i for i, _ in items]
        self.sets = [np.sort(s) for _, s in items]
        self.need = np.array([need(len(s), threshold) for s in self.sets], np.int64)
        self.single = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for s in self.sets if len(s) == 1)]))  # those of short items are among them
        keys = [s[: sketch_length(len(s), threshold)] for s in self.sets]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def matches(self, found: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles) of the items that a document's sorted set contains."""
        low, high = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return
        for item in np.unique(np.concatenate([self.owner[low[i]: high[i]] for i in hit])).tolist():
            if len(found) >= self.need[item]:
                mine = self.sets[item]
                at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
                shared = int((found[at] == mine).sum())
                if shared >= self.need[item]:
                    yield self.ids[item], shared, len(mine)


def shingle_sets(texts: DataFrame, key: str) -> DataFrame:
    """(key, shingles: sorted array of hashes) of every row with words."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = byte_table(SEED)
        for whole in parts:
            for part in text_slices(whole, "text"):
                data, off = flat_bytes(part.column("text"))
                sets = shingles_of(*words_of(data, off, hashes))
                lists = pa.array([signed(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "shingles"])

    done = texts.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(batches, "key long, shingles array<long>")
    return done.filter(F.size("shingles") > 0)


def with_short(hashes: np.ndarray, at: np.ndarray, single: np.ndarray) -> list[np.ndarray]:
    """Sets of the texts, with those of ``single`` that are a text's windows of one to four words."""
    sets = shingles_of(hashes, at)
    for width in range(1, WORDS if len(single) else 1):
        for i, windows in enumerate(shingles_of(hashes, at, width)):
            found = windows[np.isin(windows, single)]
            if len(found):
                sets[i] = np.union1d(sets[i], found)
    return sets


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, block_items: int = 20_000, short_items: bool = False) -> DataFrame:
    """One row per match: doc_id, item_id, n_shared, n_item_shingles, containment."""
    spark = docs.sparkSession
    if not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, up to 1")
    sets = written(shingle_sets(items, "item_id").select("key", F.array_sort("shingles").alias("shingles")), "benchmark-sets")
    schema = "doc_id long, item_id long, n_shared long, n_item_shingles long"
    out = spark.createDataFrame([], schema)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(block: list[tuple[int, list[int]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex([(k, unsigned(np.array(s, np.int64))) for k, s in block], threshold))

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hashes = shared.value, byte_table(SEED)
            for whole in parts:
                for part in text_slices(whole, "text"):
                    data, off = flat_bytes(part.column("text"))
                    sets = with_short(*words_of(data, off, hashes), index.single if short_items else index.single[:0])
                    rows = [(doc, *m) for doc, found in zip(part.column("doc_id").to_pylist(), sets, strict=True)
                            for m in index.matches(found)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                         names=["doc_id", "item_id", "n_shared", "n_item_shingles"])

        return source.mapInArrow(batches, schema)

    block: list[tuple[int, list[int]]] = []
    for row in sets.toLocalIterator():
        block.append((row["key"], row["shingles"]))
        if len(block) >= block_items:
            out, block = out.unionAll(run(block)), []
    if block:
        out = out.unionAll(run(block))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.75, short_items: bool = False) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Rows are told by doc_id and
    a hash of their content, so rows of one doc_id and different texts go each by its own text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    packed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("doc"))
    found = find_contaminated(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), items, threshold, short_items=short_items)
    gone = written(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return packed.join(gone, "row", "left_anti").select(*[F.col("doc")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)])

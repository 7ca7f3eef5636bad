"""Prefix trie of conversations: balanced parentheses per shard, range min-max excess blocks, merged spine.

A node is a distinct sequence of first d turns; conversations of the same turns are one path with
several members. Steps:

1. every turn gets the key of the node it ends (:func:`node_keys`): 128 bits, the sums of four
   32-bit pieces of SHA-256 over (place, role, text) of all turns up to it. These are running sums
   over range partitions, so a conversation of any length is dealt over many tasks;
2. conversations with the same last key are pre-aggregated to one path with a weight;
3. a node's weight below it is the number of turns of paths from it on. Nodes above ``shard_nodes``
   are the **spine** (closed upwards; its size is bounded by all turns / ``shard_nodes`` per depth);
   every other node lies below one topmost light node, whose subtree is whole in one task;
4. a task collects such subtrees to a **shard** and encodes it (:class:`Shard`): paths in sorted
   order give the parentheses, one pass, no pointers. The excess (opened minus closed) is kept with
   a tree of the smallest and largest excess of blocks; ``findclose`` climbs to the first block that
   holds the wanted excess and descends into it, for all nodes at once. The subtree of a node is
   what lies up to its close: leaves are the pairs ``()`` in it (rank), members and saved tokens
   differences of cumulative arrays, children the opens one deeper, the smallest member a range
   minimum;
5. shards share the spine: their totals are added to the spine node above them and summed over the
   spine by doubling (each round a node passes on its sum to the ancestor twice as far), ``log2`` of
   the spine's depth in rounds.

Members that end at a node are streamed in order through SHA-256 (:func:`end_digests`).

Defined results: null role or text counts as empty; turns are ordered by ``turn`` (nulls first), ties
by role and text, repeated rows are turns of their own; rows of a null ``conv_id`` take no part; very
long texts count whole; an empty table gives no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import parallelism, written
from pressroom.operators.running import running_sums

BLOCK = 64  # parentheses of an excess block
ROOT = bytes(16)


# ---------------------------------------------------------------- the encoding of a shard
class Excess:
    """Excess of a parenthesis sequence with the smallest and largest of every block, of every two
    blocks, and so on."""

    def __init__(self, opens: np.ndarray):
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int32)
        n_blocks = max(1, 1 << (max(1, -(-len(opens) // BLOCK)) - 1).bit_length())
        # beyond the end nothing is found: the padding's smallest excess is above every other
        padded = np.full(n_blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(n_blocks, BLOCK)
        self.low, self.high = [self.blocks.min(1)], [self.blocks.max(1)]
        while len(self.low[-1]) > 1:
            self.low.append(self.low[-1].reshape(-1, 2).min(1))
            self.high.append(self.high[-1].reshape(-1, 2).max(1))

    def _holds(self, level: int, node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (self.low[level][node] <= wanted) & (wanted <= self.high[level][node])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes the one at each place: the first place after it
        where the excess is one below."""
        wanted = self.excess[at] - 1
        found = np.full(len(at), -1, np.int64)
        block = at // BLOCK
        # the rest of the own block
        inside = (self.blocks[block] == wanted[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        here = inside.any(1)
        found[here] = block[here] * BLOCK + inside[here].argmax(1)
        todo = np.flatnonzero(~here)
        node, level = block[todo], np.zeros(len(todo), np.int64)
        # up: to the first later sibling that holds the wanted excess
        climbing = np.arange(len(todo))
        for k in range(len(self.low)):
            if not len(climbing):
                break
            at_k = node[climbing]
            right = (at_k % 2 == 0) & (at_k + 1 < len(self.low[k]))
            beside = np.minimum(at_k + 1, len(self.low[k]) - 1)
            stop = right & self._holds(k, beside, wanted[todo[climbing]])
            node[climbing[stop]], level[climbing[stop]] = beside[stop], k
            climbing = climbing[~stop]
            node[climbing] //= 2
        # down: into the first half that holds it
        for k in range(len(self.low) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            if len(down):
                left = node[down] * 2
                node[down] = left + ~self._holds(k - 1, left, wanted[todo[down]])
                level[down] = k - 1
        found[todo] = node * BLOCK + (self.blocks[node] == wanted[todo][:, None]).argmax(1)
        return found


def range_minimum(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest of ``values[begin:end]`` for each pair (end > begin)."""
    power = np.floor(np.log2(end - begin)).astype(np.int64)
    out = np.empty(len(begin), values.dtype)
    table = values
    for k in range(int(power.max(initial=0)) + 1):
        now = power == k
        out[now] = np.minimum(table[begin[now]], table[end[now] - (1 << k)])
        if len(table) > (1 << k):
            table = np.minimum(table[: -(1 << k)], table[1 << k:])
    return out


class Shard:
    """A forest of paths. ``paths``: (keys from a top node to the end, bytes of their last texts,
    depth of the first, members, smallest member), no two with the same keys."""

    def __init__(self, paths: list[tuple[list[bytes], list[int], int, int, int]]):
        paths = sorted(paths, key=lambda p: p[0])
        opens, keys, sizes, depths, ends, firsts = bytearray(), [], [], [], [], []
        before: list[bytes] = []
        for path, n_bytes, depth, members, first in paths:
            shared, most = 0, min(len(before), len(path))
            while shared < most and before[shared] == path[shared]:
                shared += 1
            opens += b"\0" * (len(before) - shared) + b"\1" * (len(path) - shared)
            keys += path[shared:]
            sizes += n_bytes[shared:]
            depths += range(depth + shared, depth + len(path))
            # sorted and distinct, so a path that ends inside another one comes before it: its end is the last open
            ends += [0] * (len(path) - shared - 1) + [members]
            firsts += [np.iinfo(np.int64).max] * (len(path) - shared - 1) + [first]
            before = path
        opens += b"\0" * len(before)
        self.opens = np.frombuffer(bytes(opens), np.uint8).astype(bool)
        self.keys, self.depths = keys, np.array(depths, np.int64)
        self.sizes, self.ends, self.firsts = (np.array(x, np.int64) for x in (sizes, ends, firsts))

    def nodes(self) -> dict[str, np.ndarray]:
        """Per node, in order of their opens: members, children, leaves, saved tokens of the subtree,
        smallest member, and the place of the parent (-1: a top)."""
        at = np.flatnonzero(self.opens)
        tree = Excess(self.opens)
        close = tree.findclose(at)
        rank = np.cumsum(self.opens)
        begin, end = rank[at] - 1, rank[close]  # the nodes of the subtree are begin .. end - 1
        pairs = self.opens.copy()
        pairs[:-1] &= ~self.opens[1:]
        leaves = np.append(0, np.cumsum(pairs))
        members_to = np.append(0, np.cumsum(self.ends))
        n_convs = members_to[end] - members_to[begin]
        saved_to = np.append(0, np.cumsum((n_convs - 1) * self.sizes))
        # opens by (excess, place): the children of a node are a run one level below it
        level = tree.excess[at].astype(np.int64)
        span = len(self.opens) + 1
        ordered = np.sort(level * span + at)
        children = np.searchsorted(ordered, (level + 1) * span + close) - np.searchsorted(ordered, (level + 1) * span + at)
        above = np.searchsorted(ordered, (level - 1) * span + at) - 1
        parent = np.where(level > 1, rank[np.where(level > 1, ordered[above] % span, 0)] - 1, -1)
        return {"n_convs": n_convs, "n_children": children, "n_leaves": leaves[close] - leaves[at], "saved": saved_to[end] - saved_to[begin],
                "first": range_minimum(self.firsts, begin, end), "parent": parent}


NODES = ("key binary, above binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, is_top boolean")


def _encode_shards(shard_nodes: int):
    def rows_of(paths: list) -> pa.RecordBatch:
        shard = Shard([p[2:] for p in paths])
        above = {p[2][0]: p[1] for p in paths}
        x = shard.nodes()
        top = x["parent"] < 0
        at = np.where(top, 0, x["parent"])
        parents = [above[k] if t else shard.keys[i] for k, t, i in zip(shard.keys, top.tolist(), at.tolist(), strict=True)]
        columns = [pa.array(shard.keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(shard.depths), pa.array(x["first"]),
                   pa.array(x["first"][at], mask=top), *(pa.array(x[c]) for c in ("n_convs", "n_children", "n_leaves", "saved")), pa.array(top)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "above", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
                                                          "n_leaves", "saved_tokens", "is_top"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows (top, path, depth, ...) in this order; a shard closes between two tops
        paths, n, now = [], 0, None
        for batch in batches:
            for top, path, depth, key, parent, n_bytes, members, first in zip(*(batch.column(c).to_pylist() for c in (
                    "top", "path", "depth", "key", "above", "n_bytes", "members", "first")), strict=True):
                if (top, path) != now:
                    if paths and n >= shard_nodes and top != now[0]:
                        yield rows_of(paths)
                        paths, n = [], 0
                    now = (top, path)
                    paths.append((top, parent, [], [], depth, members, first))
                paths[-1][2].append(key)
                paths[-1][3].append(n_bytes)
                n += 1
        if paths:
            yield rows_of(paths)

    return encode


# ---------------------------------------------------------------- conversations to paths
def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the turns with their place from 0 on."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    done = running_sums(rows, {"at": F.lit(1).cast("long")}, order, ["conv_id"])
    return done.select("conv_id", (F.col("at") - 1).alias("at"), "role", "text")


def with_shared_openings(turns: DataFrame, group: int = 5, lengths: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation ``c - c % group`` (all if
    fewer, none if there is no such conversation), then its own turns after its first h; h is
    crc32 of the decimal c modulo ``lengths`` (remainders are those of SQL). Returns the ids of all
    conversations and the rebuilt turns as (conv_id, at, role, text)."""
    rows = written(in_order(turns), "trie-turns")
    ids = written(rows.select("conv_id").distinct(), "trie-ids")
    # only the first turns of a group's conversation are copied, to at most ``group`` conversations
    heads = rows.filter((F.col("conv_id") % group == 0) & (F.col("at") < lengths)).withColumnRenamed("conv_id", "base")
    wants = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths).alias("h"))
    wants = wants.join(heads.groupBy("base").agg(F.count("*").alias("_n")), "base", "left")
    wants = written(wants.select("conv_id", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken")), "trie-openings")
    opening = wants.join(heads, "base").filter(F.col("at") < F.col("h")).select("conv_id", "at", "role", "text")
    own = rows.join(wants, "conv_id").filter(F.col("at") >= F.col("h"))
    return ids, opening.unionByName(own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "role", "text"))


def node_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, above, n_bytes) of turns (conv_id, at, role, text) with places from 0 on:
    per turn the node it ends and the node above."""
    # the digest of the role fixes where the role ends in the other digest, whatever role and text hold
    digest = F.sha2(F.concat_ws(":", F.col("at").cast("string"), F.sha2("role", 256), F.sha2(F.concat("role", "text"), 256)), 256)
    rows = turns.select("conv_id", (F.col("at") + 1).alias("depth"), F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("_d"))
    piece = lambda i: F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long")
    rows = rows.select("conv_id", "depth", "n_bytes", *[piece(i).alias(f"_p{i}") for i in range(4)])
    sums = running_sums(rows, {f"_s{i}": F.col(f"_p{i}") for i in range(4)}, ["depth"], ["conv_id"])
    part = lambda c: F.lpad(F.hex(F.pmod(c, F.lit(1 << 32))), 8, "0")
    key = F.unhex(F.concat(*[part(F.col(f"_s{i}")) for i in range(4)]))
    above = F.unhex(F.concat(*[part(F.col(f"_s{i}") - F.col(f"_p{i}")) for i in range(4)]))
    return sums.select("conv_id", "depth", key.alias("key"), F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(above).alias("above"), "n_bytes")


# ---------------------------------------------------------------- members that end at a node
def end_digests(ends: DataFrame, piece_bytes: int = 1 << 16) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): SHA-256 of the decimal ids, ascending, comma-joined.
    Ids are range-partitioned by (key, id) and joined to pieces of bounded size where they lie; the
    digest then reads a node's pieces one after the other, holding one."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, ids, size = [], None, [], 0
        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != now or size >= piece_bytes:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids, size = key, [], 0
                ids.append(conv)
                size += len(str(conv)) + 1
            if out:
                yield table(out)
                out = []
        if ids:
            yield table([(now, ids[0], ",".join(map(str, ids)))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        key, first, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], names=["key", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if key != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield hashes(done)
        if state:
            yield hashes([(now, state.hexdigest())])

    def hashes(rows: list[tuple]) -> pa.RecordBatch:
        key, digest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(digest, pa.string())], names=["key", "ends_sha256"])

    parts = parallelism(ends.sparkSession)
    dealt = ends.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = dealt.mapInArrow(pieces, "key binary, first long, piece string")
    return found.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


# ---------------------------------------------------------------- the spine
def spine_totals(spine: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over each node's spine subtree, itself included, by doubling: after round k
    a node holds the sum of the descendants less than 2**k below it. ``spine``: (key, above, ...)."""
    now = written(spine.select("key", F.col("above").alias("_up"), *values), "spine")
    while not now.filter(F.col("_up").isNotNull()).isEmpty():
        sent = now.filter(F.col("_up").isNotNull()).groupBy(F.col("_up").alias("key")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        further = now.select(F.col("key").alias("_up"), F.col("_up").alias("_next"))
        now = written(now.join(sent, "key", "left").join(further, "_up", "left").select(
            "key", F.col("_next").alias("_up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "spine")
    return now.drop("_up")


def prefix_trie(ids: DataFrame, turns: DataFrame, shard_nodes: int = 4096) -> DataFrame:
    """The nodes of the trie of conversations ``ids`` (conv_id) with turns (conv_id, at, role, text):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key."""
    spark = ids.sparkSession
    parts = parallelism(spark)
    rows = written(node_keys(turns), "trie-keys")
    last = rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max_by("key", "depth").alias("key"))
    ends = written(ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"),
                                                            F.coalesce("key", F.lit(ROOT)).alias("key")), "trie-ends")
    # conversations of the same turns: one path
    paths = ends.groupBy("key").agg(F.count("*").alias("members"), F.min("conv_id").alias("path"), F.first("length").alias("length"))
    paths = written(paths.select("path", "members", "length"), "trie-paths")
    steps = rows.withColumnRenamed("conv_id", "path").join(paths, "path")
    # turns from a node on, over its paths; the root is always of the spine
    weights = steps.groupBy("key").agg(F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    heavy = written(weights.filter(F.col("weight") > shard_nodes).select("key"), "trie-heavy")
    steps = written(steps.join(heavy.withColumn("heavy", F.lit(True)), "key", "left").select(
        "path", "depth", "key", "above", "n_bytes", "members", F.coalesce("heavy", F.lit(False)).alias("heavy")), "trie-steps")

    tops = steps.filter(~F.col("heavy")).groupBy("path").agg(F.min_by("key", "depth").alias("top"))
    light = steps.filter(~F.col("heavy")).join(tops, "path").select(
        "top", "path", "depth", "key", "above", "n_bytes", "members", F.col("path").alias("first"))
    shards = light.repartition(parts, "top").sortWithinPartitions("top", "path", "depth")
    below = written(shards.mapInArrow(_encode_shards(shard_nodes), NODES), "trie-shards")

    # spine: members and smallest member of a node are those of all paths through it
    through = steps.filter("heavy").groupBy("key").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.min("path").alias("conv_id"),
        F.sum("members").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    root = paths.agg(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("depth"),
                     F.min("path").alias("conv_id"), F.sum("members").alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"))
    spine = through.unionByName(root.filter(F.col("conv_id").isNotNull()))
    hung = below.filter("is_top").groupBy(F.col("above").alias("key")).agg(
        F.count("*").alias("n_tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = spine.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_inner"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    spine = written(spine.join(hung, "key", "left").join(inner, "key", "left").select(
        "key", "above", "depth", "conv_id", "n_convs", (zero("n_tops") + zero("n_inner")).alias("n_children"),
        F.when(zero("n_tops") + zero("n_inner") == 0, 1).otherwise(zero("leaves")).alias("leaves"),
        (zero("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "trie-spine")
    totals = spine_totals(spine, ["leaves", "saved"]).select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    names = spine.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    upper = spine.drop("leaves", "saved").join(totals, "key").join(names, "above", "left")
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    crowns = below.filter("is_top").drop("parent_conv_id").join(names, "above", "left")
    nodes = below.filter("NOT is_top").select(*columns).unionByName(crowns.select(*columns)).unionByName(upper.select(*columns))
    digests = end_digests(ends)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    done = nodes.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return done.select(*columns[1:], "ends_sha256", "key")


def conversation_trie(turns: DataFrame, shard_nodes: int = 4096) -> DataFrame:
    """The trie of all conversations with shared openings, see :func:`with_shared_openings`."""
    ids, rebuilt = with_shared_openings(turns)
    return prefix_trie(ids, rebuilt, shard_nodes)


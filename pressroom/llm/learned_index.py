"""Approximate nearest neighbours over learned partitions.

1. **Fit**, on the driver, on a bounded sample (``sample`` rows, those of the smallest hash of their
   id): the exact neighbour graph of the sample; a balanced partitioning of that graph
   (:func:`balanced_partition`: recursive halving along the direction of largest spread, then moves
   that cut fewer edges while parts stay within ``slack`` of equal size); a small classifier, one
   hidden layer, trained to tell from a vector how its neighbours spread over the parts.
2. **Index**: the classifier names the part of every row; each part is dealt out in blocks of about
   ``block_rows`` rows by a hash of the id, so a part of any size (a vector copied millions of times)
   is many blocks.
3. **Route**: a query goes to its ``probes`` most probable parts, and on to further ones until these
   hold ``k + 1`` rows at least. ``probes`` is the smallest number with which held-out rows of the
   sample find ``recall`` of their true neighbours in the sample; the whole table is denser than its
   sample, so neighbours are nearer there and found rather more often.
4. **Rerank**: query blocks meet row blocks, squares of bounded size; distances are Euclidean, in
   double precision, on the vectors as stored. Each square passes on k rows a query, a window
   keeps the k nearest.

Nothing is capped: every row is in one block, and every block of a probed part is searched.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without id or of another length than most vectors have (ties: the shorter). Rows
of one id count once (the smallest vector). Ties in distance go to the smaller id. With fewer than k
candidates all are returned, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import written

#: Most rows the index is fitted on, most parts it has, rows of a part where the table allows it.
SAMPLE, PARTS, PART_ROWS = 8_192, 256, 1_024


# ---------------------------------------------------------------- fitting
def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row (as many as there are)."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = squared(x[a: a + 512], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a: a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 8) -> np.ndarray:
    """A part of every vertex, sizes equal up to ``slack``, few edges between parts."""
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
        left = count // 2
        cut = len(order) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    most = math.ceil(n / parts * (1 + slack))
    least = math.floor(n / parts * (1 - slack))
    sizes = np.bincount(part, minlength=parts)
    # edges count in both directions
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        near = np.zeros((n, parts), np.int32)
        np.add.at(near, (starts, part[ends]), 1)
        gain = near.max(1) - near[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            now, wanted = part[v], int(near[v].argmax())
            if sizes[wanted] < most and sizes[now] > least:
                part[v] = wanted
                sizes[now] -= 1
                sizes[wanted] += 1
                moved += 1
        if moved <= n // 500:
            break
    return part


class Router:
    """A classifier of one hidden layer, from vectors to parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() or 1.0
        z = self.prepare(x)
        dim, parts = x.shape[1], target.shape[1]
        self.weights = [rng.normal(0, 1 / math.sqrt(dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        means, squares, step = [0.0] * 4, [0.0] * 4, 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs)
            order = rng.permutation(len(z))
            for a in range(0, len(z), 256):
                rows = order[a: a + 256]
                step += 1
                for i, g in enumerate(self._gradients(z[rows], target[rows])):  # Adam
                    means[i] = 0.9 * means[i] + 0.1 * g
                    squares[i] = 0.999 * squares[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def _gradients(self, z: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        w, b, v, c = self.weights
        h = np.maximum(z @ w + b, 0)
        d = (self._softmax(h @ v + c) - target) / len(z)
        back = (d @ v.T) * (h > 0)
        return [z.T @ back, back.sum(0), h.T @ d, d.sum(0)]

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return self._softmax(np.maximum(self.prepare(x) @ w + b, 0) @ v + c)


def fit(x: np.ndarray, parts: int, k: int, recall: float, seed: int = 11) -> tuple[Router, int]:
    """The router of ``parts`` parts and the number of parts to probe. A tenth of the sample is held
    out of the training and measures the recall."""
    held = np.zeros(len(x), bool)
    held[::10] = len(x) >= 40
    train = x[~held]
    parts = max(1, min(parts, len(train) // 4))
    if parts == 1:
        return Router(train, np.ones((len(train), 1)), epochs=0), 1
    graph = neighbour_graph(train, 10)
    part = balanced_partition(train, graph, parts)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.arange(len(train)), part), graph.shape[1])
    np.add.at(target, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph.ravel()]), 1.0)
    router = Router(train, target / target.sum(1, keepdims=True), seed=seed)
    if not held.any():
        return router, parts
    # the share of the k true neighbours that lie in the first 1, 2, ... probed parts
    own = router.probabilities(x).argmax(1)
    at = np.flatnonzero(held)
    d = squared(x[at], x)
    d[np.arange(len(at)), at] = np.inf
    k = min(k, len(x) - 1)
    nearest = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = np.argsort(-router.probabilities(x[at]), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each part, in the order of probing
    found = np.sort(np.take_along_axis(place, own[nearest], 1).ravel())
    return router, int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1


# ---------------------------------------------------------------- searching
def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, one per id."""
    good = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    odd = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = good.filter((F.size("vec") > 0) & ~odd & F.exists("vec", lambda c: c != 0))
    good = written(good.groupBy("vec_id").agg(F.min("vec").alias("vec")), "ann-rows")
    # one row per length, the most frequent first
    lengths = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("vec") == lengths[0]["n"]) if lengths else good


def nearest(rows: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", recall: float = 0.97,
            part_rows: int = PART_ROWS, max_parts: int = PARTS, sample: int = SAMPLE, block_rows: int = 512, block_queries: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row whose id is divisible by
    ``every``, among all other rows. ``sample`` bounds what the index is fitted on, nothing else."""
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    total = good.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r["vec"] for r in drawn], np.float64)
    router, probes = fit(x, max(1, min(max_parts, max(total // part_rows, 8))), k, recall)
    parts = len(router.weights[3])

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(matrix(batch.column("vec"))).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["vec_id", "vec", "part"])

    index = written(good.select("vec_id", "vec").mapInArrow(part_of, "vec_id long, vec array<double>, part int"), "ann-index")
    # one figure per part: bounded by max_parts
    sizes = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.probabilities(matrix(batch.column("vec"))), axis=1, kind="stable")
            # as many parts as it takes, by the fixed number and by their rows (the query's own is one of them)
            held_before = np.cumsum(sizes[order], axis=1) - sizes[order]
            probed = (np.arange(parts) < probes) | (held_before < k + 1)
            at, place = np.nonzero(probed & (sizes[order] > 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("vec").take(pa.array(at)),
                                              pa.array(order[at, place].astype(np.int32))], names=["query_id", "vec", "part"])

    queries = index.filter(F.col("vec_id") % every == 0).select("vec_id", "vec").mapInArrow(route, "query_id long, vec array<double>, part int")
    queries = written(queries, "ann-queries")
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    # blocks of a part: rows and queries are dealt by hash, and every pair of blocks meets once
    row_blocks = [max(1, -(-int(n) // block_rows)) for n in sizes]
    query_blocks = [max(1, -(-asked.get(p, 0) // block_queries)) for p in range(parts)]
    blocks = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("part") + 1)
    dealt = lambda key, counts: F.pmod(F.xxhash64(key, F.lit(1)), blocks(counts)).cast("int")
    span = lambda counts: F.explode(F.sequence(F.lit(0), blocks(counts) - 1))
    left = queries.select("query_id", "vec", "part", dealt("query_id", query_blocks).alias("qb")).select("*", span(row_blocks).alias("rb"))
    right = index.select("vec_id", "vec", "part", dealt("vec_id", row_blocks).alias("rb"))
    right = right.filter(F.col("part").isin(sorted(asked))).select("*", span(query_blocks).alias("qb"))

    def rerank(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out_query, out_row, out_score = [], [], []
        if len(ours) and len(theirs):
            ids = theirs.column("vec_id").to_numpy()
            vectors = matrix(theirs.column("vec"))
            for query, vec in zip(ours.column("query_id").to_pylist(), matrix(ours.column("vec")), strict=True):
                score = np.sqrt(((vectors - vec) ** 2).sum(1))
                best = np.lexsort((ids, score))[: k + 1]
                best = best[ids[best] != query][:k]
                out_query.append(np.full(len(best), query, np.int64))
                out_row.append(ids[best])
                out_score.append(score[best])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": join(out_query, np.int64), "vec_id": join(out_row, np.int64), "score": join(out_score, np.float64)})

    cell = ["part", "rb", "qb"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(ids: np.ndarray, x: np.ndarray, k: int, every: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force, for measuring recall on tables that fit."""
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, score))[: k + 1] if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in best]
    return out

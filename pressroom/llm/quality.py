"""Quality classifier by co-training of two views.

View ``text``: presence of hashed words (bare, lower-cased) and figures of the characters.
View ``page``: the page's metadata: source, language, length, lines. Each view has a logistic
classifier. Per round both are fitted and calibrated, each labels an unlabelled pool, and the rows
it is confident of (calibrated probability beyond ``confident`` on either side) join the other's
training rows with its label. At the end a logistic model over the two calibrated logits, fitted on
held-out labelled rows, combines the views, and all documents are scored.

Fitting is on bounded samples (``max_labelled`` labelled and ``max_pool`` unlabelled rows, the
smallest by hash of doc_id): their features, not their texts, come to the driver. Scoring goes over
all documents and whole texts.

A document is wanted when its label says quality 1 and toxic not 1. It is rejected when its score
is below ``threshold``.

Defined results: null text, source or language count as empty; labels with null quality or doc_id
are not used, nor those of documents that are not in the table, of several labels of a document the
lowest quality counts; without labels of both kinds nothing can be learnt, every score is 1 and all
documents stay; repeated rows score alike; an empty table gives no rows; all columns pass through,
but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from pressroom.llm.common import NOT_WORD, SPACE, byte_table, flat_bytes, text_slices, words_of

BITS = 20  # of a hashed word
SEED = 17
RESULT = ("text_score", "page_score", "score", "keep")
TEXT_FIGURES = 9
PAGE_FIGURES = 3


def _share(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(1, off[1:] - off[:-1])


UPPER, DIGIT, MARK = np.zeros(256, bool), np.zeros(256, bool), NOT_WORD & ~SPACE
UPPER[65:91] = DIGIT[48:58] = True
RARE = MARK.copy()
RARE[[*b".,;:'\"()-!?"]] = False


def features(part: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each row: hashed words, text figures; hashed metadata, page figures."""
    data, off = flat_bytes(part.column("text"))
    hashes, at = words_of(data, off, byte_table(SEED), NOT_WORD)
    short = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    words = [np.unique(short[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    count, size = np.diff(at), np.diff(off)
    figures = np.column_stack([
        _share(UPPER[data], off), _share(DIGIT[data], off), _share(MARK[data], off), _share(RARE[data], off), _share(data == ord("!"), off),
        _share(data == ord("|"), off), _share(SPACE[data], off), np.array([len(w) for w in words]) / np.maximum(1, count), np.log1p(size / np.maximum(1, count))])
    meta = []
    for source, lang in zip(part.column("source").to_pylist(), part.column("lang").to_pylist(), strict=True):
        keys = np.frombuffer(f"s {source or ''}\nl {lang or ''}\nb {source or ''} {lang or ''}".encode(), np.uint8)
        line = np.flatnonzero(keys == 10)
        cut = np.concatenate(([0], line + 1, [len(keys)]))
        separator = np.zeros(256, bool)
        separator[10] = True
        meta.append((words_of(keys, cut, byte_table(SEED + 1, lower=False), separator)[0] >> np.uint64(64 - BITS)).astype(np.int64))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    n_lines = lines[off[1:]] - lines[off[:-1]] + (size > 0)
    page = np.column_stack([np.log1p(size), np.log1p(n_lines), np.log1p(size / np.maximum(1, n_lines))])
    return words, figures, meta, page


class Rows:
    """Features of one view: hashed words in one array with offsets, and figures."""

    def __init__(self, words: list[np.ndarray], figures: np.ndarray):
        self.ids = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.off = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        self.figures = figures

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, rows: np.ndarray) -> Rows:
        return Rows([self.ids[self.off[i]: self.off[i + 1]] for i in rows], self.figures[rows])


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[off[1:]] - total[off[:-1]]


class Logistic:
    """Logistic regression over hashed words and standardised figures; full-batch Adam from
    log-odds, fixed steps, no randomness. Only words that tell the kinds apart are used: those whose
    count in wanted rows is ``apart`` standard deviations or more from what all rows let expect.
    The many others would only add up to noise in long texts."""

    def fit(self, rows: Rows, y: np.ndarray, steps: int = 250, rate: float = 0.1, penalty: float = 2e-6, apart: float = 4.0) -> Logistic:
        self.mean, self.scale = rows.figures.mean(0), rows.figures.std(0) + 1e-6
        n, x = len(rows), np.clip((rows.figures - self.mean) / self.scale, -6, 6)
        row = np.repeat(np.arange(n), np.diff(rows.off))
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        seen = np.bincount(rows.ids, minlength=1 << BITS)
        gap = np.abs(np.bincount(rows.ids, weights=y[row], minlength=1 << BITS) - prior * seen)
        used = np.flatnonzero((seen > 0) & (gap >= apart * np.sqrt(prior * (1 - prior) * seen)))
        place = np.full(1 << BITS, len(used))
        place[used] = np.arange(len(used))
        ids = place[rows.ids]
        good = np.bincount(ids, weights=y[row], minlength=len(used) + 1)
        of = np.bincount(ids, minlength=len(used) + 1)
        w = 0.3 * (np.log((good + 2 * prior) / (of - good + 2 * (1 - prior))) - np.log(prior / (1 - prior)))
        v, b = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
        theta = np.concatenate((w, v, [b]))
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        k = len(used) + 1
        for step in range(1, steps + 1):
            theta[k - 1] = 0
            z = _sums(theta[ids], rows.off) + x @ theta[k:-1] + theta[-1]
            gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grad = np.concatenate((np.bincount(ids, weights=gap[row], minlength=k) / n, x.T @ gap / n, [gap.mean()]))
            grad[:-1] += penalty * theta[:-1]
            m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        theta[k - 1] = 0
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[used] = theta[: k - 1]
        self.figure_weights, self.bias, self.a, self.b = theta[k:-1], theta[-1], 1.0, 0.0
        return self

    def logits(self, rows: Rows) -> np.ndarray:
        x = np.clip((rows.figures - self.mean) / self.scale, -6, 6)
        return self.a * (_sums(self.weights[rows.ids], rows.off) + x @ self.figure_weights + self.bias) + self.b

    def calibrate(self, rows: Rows, y: np.ndarray) -> Logistic:
        """Platt scaling on rows that were not fitted on."""
        self.a, self.b = _newton(self.logits(rows)[:, None], y)
        return self


def _newton(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on a few columns: their weights, then the bias."""
    x = np.column_stack((np.clip(x, -30, 30), np.ones(len(x))))
    theta = np.zeros(x.shape[1])
    theta[:-1] = 1.0 / max(1, x.shape[1] - 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta))
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * theta)
        theta -= step / max(1.0, np.abs(step).max())
    return theta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features_frame(docs: DataFrame) -> DataFrame:
    schema = "key long, y double, words array<int>, figures array<double>, meta array<int>, page array<double>"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in text_slices(whole, "text"):
                words, figures, meta, page = features(part)
                ints, floats = pa.list_(pa.int32()), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("y"), pa.array([w.astype(np.int32) for w in words], ints), pa.array(list(figures), floats),
                     pa.array([w.astype(np.int32) for w in meta], ints), pa.array(list(page), floats)],
                    names=["key", "y", "words", "figures", "meta", "page"])

    return docs.mapInArrow(batches, schema)


def _views(table: pa.Table) -> tuple[Rows, Rows, np.ndarray]:
    lists = lambda c: [x.values.to_numpy().astype(np.int64) for x in table.column(c)]
    figures = lambda c, k: np.array(table.column(c).to_pylist(), float).reshape(-1, k)
    return (Rows(lists("words"), figures("figures", TEXT_FIGURES)), Rows(lists("meta"), figures("page", PAGE_FIGURES)),
            np.array(table.column("y").to_pylist(), float))


def _join(rows: Rows, more: Rows) -> Rows:
    both = Rows([], np.concatenate((rows.figures, more.figures)))
    both.ids = np.concatenate((rows.ids, more.ids))
    both.off = np.concatenate((rows.off, rows.off[-1] + more.off[1:]))
    return both


def co_train(text: Rows, page: Rows, y: np.ndarray, pool_text: Rows, pool_page: Rows, rounds: int, confident: float,
             ) -> tuple[Logistic, Logistic, np.ndarray] | None:
    """Both classifiers and the weights that combine them; None if the labels show one kind only.
    Every fifth labelled row is held out for calibration and combination."""
    held = np.arange(len(y)) % 5 == 0
    own, out = np.flatnonzero(~held), np.flatnonzero(held)
    if len(y) < 20 or min(y[own].sum(), (1 - y[own]).sum(), y[out].sum(), (1 - y[out]).sum()) < 1:
        return None
    views = {"text": (text, pool_text), "page": (page, pool_page)}
    extra = {v: (np.zeros(0, np.int64), np.zeros(0)) for v in views}
    models: dict[str, Logistic] = {}
    for _ in range(max(1, rounds)):
        sure = {}
        for v, (rows, pool) in views.items():
            at, label = extra[v]
            models[v] = Logistic().fit(_join(rows.take(own), pool.take(at)), np.concatenate((y[own], label))).calibrate(rows.take(out), y[out])
            p = sigmoid(models[v].logits(pool))
            pick = np.flatnonzero((p >= confident) | (p <= 1 - confident))
            sure[v] = (pick, (p[pick] >= 0.5).astype(float))
        extra = {"text": sure["page"], "page": sure["text"]}
    stacked = np.column_stack([models[v].logits(views[v][0].take(out)) for v in ("text", "page")])
    return models["text"], models["page"], _newton(stacked, y[out])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rounds: int = 3, confident: float = 0.97,
                    max_labelled: int = 12_000, max_pool: int = 6_000) -> DataFrame:
    """Add text_score, page_score, score and keep to every document."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1.0).otherwise(0.0)).alias("y"))
    plain = docs.select(F.col("doc_id").cast("long").alias("key"), "text", "source", "lang")
    here = known.join(plain.select("key"), "key", "left_semi")  # labels may name documents of other tables
    sample = here.orderBy(F.xxhash64("key"), "key").limit(max_labelled)  # bounded, so it may be broadcast
    labelled = _features_frame(plain.join(F.broadcast(sample), "key").select("key", "y", "text", "source", "lang")).orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    pool_ids = docs.select(F.col("doc_id").cast("long").alias("key")).filter(F.col("key").isNotNull()).orderBy(F.xxhash64("key", F.lit(1)), "key").limit(max_pool)
    pool = _features_frame(plain.join(F.broadcast(pool_ids.distinct().select("key", F.lit(-1.0).alias("y"))), "key")
                           .select("key", "y", "text", "source", "lang")).orderBy(F.xxhash64("key"), "key").limit(max_pool)
    (text, page, y), (pool_text, pool_page, _) = _views(labelled.toArrow()), _views(pool.toArrow())
    fitted = co_train(text, page, y, pool_text, pool_page, rounds, confident)
    shared = spark.sparkContext.broadcast(fitted)  # weights: 2 ** BITS per view, whatever the data

    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT])
    schema = StructType([*source.schema.fields, *(StructField(c, DoubleType()) for c in RESULT[:3]), StructField(RESULT[3], BooleanType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for whole in parts:
            for part in text_slices(whole, "text"):
                if models is None:
                    p = [np.ones(part.num_rows)] * 3
                else:
                    words, figures, meta, page = features(part)
                    z = np.column_stack((models[0].logits(Rows(words, figures)), models[1].logits(Rows(meta, page))))
                    p = [sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(np.clip(z, -30, 30) @ models[2][:2] + models[2][2])]
                add = [*(pa.array(x) for x in p), pa.array(p[2] >= threshold)]
                yield pa.RecordBatch.from_arrays([*part.columns, *add], names=[*part.schema.names, *RESULT])

    return source.mapInArrow(batches, schema)


def keep_wanted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their own columns, also those named like a result."""
    aside = {c: f"own_{c}" for c in docs.columns if c.lower() in RESULT}
    scored = score_documents(docs.withColumnsRenamed(aside), labels, **options).filter("keep")
    return scored.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])

"""Substring dedup by column-wise construction of a collection's suffix order.

Removes every byte that lies in a string of ``length`` bytes that also starts earlier: in a
document of smaller doc_id, or in the same document at an earlier start. All judged on the input.

Routing. Every window of ``length`` bytes has a fingerprint, the smallest hash of its ``anchor``-byte
substrings, so equal windows have equal fingerprints. Neighbouring windows of one fingerprint are cut
out together as a fragment (at most ``RUN`` windows). Copies of a fragment are taken together where
they meet, first within a scan task, then per fingerprint: all but the first are covered as a whole,
and only the first goes on. A fingerprint with one distinct fragment that does not repeat in itself
is then done. A fingerprint with more than ``hot`` distinct fragments is taken window by window: each
scan task keeps the first place of every distinct window and covers the others, and what is kept is
routed by the window's own hash, sorted and streamed by content, and covered but for the first. These
windows need no suffix order. Other fingerprints go there whole: a group holds up to ``hot``
fragments, and a collection up to a group more than ``collection_bytes``.

Suffix order. What is left is dealt by fingerprint, and each task builds the suffix order of its
fragments as collections of bounded size (:class:`Collection`): round j inserts the suffix of j bytes
of all fragments at once. Where it goes follows from the Burrows-Wheeler transform so far: its place
is the count of smaller symbols plus the count of its own first symbol above the row of the suffix
one byte shorter. The transform and the common prefixes of neighbouring rows are files, read and
written front to back once a round. In the end rows with a common prefix of ``length`` bytes or more
are equal windows; all but the earliest are covered.

The files belong to the running task and go with it. No text passes the driver.

Defined results: null text counts as empty; texts shorter than ``length`` are left alone; null doc_id
comes first; rows of equal doc_id and different text are ordered by a hash; rows equal in doc_id and
text are one document and get one result; fragments are compared by 64-bit hash where they are taken
together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import U64, blocks_by_part, byte_table, changes, dealt_blocks, flat_bytes, mix64, parallelism, signed, text_slices, written

SEED = 100
RUN = 64  # windows of a fragment
NULL_ID = -(2**63)  # stands for a null doc_id
FLUSH = 500_000  # fragments that a scan task gathers before it passes them on
WINDOWS = 100_000  # windows of hot fingerprints, and copies of them, that a task gathers
COLD, HOT, COVERED = range(3)
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 2**64)


class Powers:
    """Powers of the multiplier and of its inverse, as long as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, MULTIPLIER, U64))))
            self.down = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, INVERSE, U64))))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def fragments(data: np.ndarray, off: np.ndarray, length: int, anchor: int, powers: Powers,
              ) -> tuple[np.ndarray, ...]:
    """Of the texts in ``data``: (text number, start, windows, fingerprint, content hash, may
    repeat in itself) of every fragment."""
    n, width = len(data), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, bool))
    powers.reach(n + 1)
    h = np.concatenate((np.zeros(1, U64), np.cumsum(byte_table(SEED, lower=False)[data] * powers.up[:n])))
    grams = mix64((h[anchor:] - h[:-anchor]) * powers.down[: n - anchor + 1])
    least = sliding_min(grams, width)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    valid = np.arange(len(least)) + length <= off[1:][text]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(begin)
    if not len(first):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, bool))
    run = np.cumsum(begin) - 1
    place = np.arange(len(least)) - first[np.maximum(run, 0)]
    begin = valid & (place % RUN == 0)
    start = np.flatnonzero(begin)
    windows = np.bincount((np.cumsum(begin) - 1)[valid], minlength=len(start))
    size = windows + length - 1
    content = mix64((h[start + size] - h[start]) * powers.down[start] + size.astype(U64))
    found, again = least[start], np.zeros(len(start), bool)
    reach = np.arange(width + RUN - 1)
    for a in range(0, len(start), 8192):  # in a window that repeats, the smallest gram stands at two places
        s, k = start[a: a + 8192], windows[a: a + 8192]
        at = np.minimum(s[:, None] + reach, len(grams) - 1)
        again[a: a + 8192] = ((grams[at] == found[a: a + 8192, None]) & (reach < (width + k - 1)[:, None])).sum(1) > 1
    return text[start], start - off[:-1][text[start]], windows, found, content, again


def merge_spans(doc: np.ndarray, uid: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted spans [a, b) per document, overlapping and touching ones joined."""
    order = np.lexsort((b, a, uid, doc))
    doc, uid, a, b = doc[order], uid[order], a[order], b[order]
    if not len(a):
        return doc, uid, a, b
    new = changes(doc, uid)
    group = np.cumsum(new) - 1
    shift = group * (int(b.max()) + 1)
    far = np.maximum.accumulate(b + shift) - shift
    new[1:] |= a[1:] > far[:-1]
    first = np.flatnonzero(new)
    return doc[first], uid[first], a[first], np.maximum.reduceat(b, first)


class Entries:
    """Fragments by column, all of one length: fp, content, doc, uid, start, windows, again."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns

    @staticmethod
    def joined(parts: list[tuple]) -> Entries:
        return Entries(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def take(self, rows: np.ndarray) -> Entries:
        return Entries(*(c[rows] for c in self.columns))

    def firsts(self) -> tuple[Entries, tuple[np.ndarray, ...]]:
        """The first of each (fingerprint, content) in document order, sorted by fingerprint; the
        spans of the others."""
        fp, content, doc, uid, start, _, _ = self.columns
        e = self.take(np.lexsort((start, uid, doc, content, fp)))
        fp, content, doc, uid, start, windows, _ = e.columns
        same = ~changes(fp, content)
        rest = np.flatnonzero(same & changes(doc, uid, start))
        # a row that is equal to the first in all is the same place, and so is one equal to a later one
        return e.take(np.flatnonzero(~same)), (doc[rest], uid[rest], start[rest], windows[rest])


class Collection:
    """Suffix order of strings, one symbol of all of them a round."""

    def __init__(self, strings: list[bytes], folder: str):
        self.strings, self.folder = strings, folder
        self.sizes = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        # the bytes that occur, numbered from 1 in their order; 0 ends a string. UTF-8 has no more than 243
        occur = np.bincount(data, minlength=256) > 0
        self.symbol = np.uint8 if occur.sum() < 256 else np.uint16
        self.data = np.cumsum(occur).astype(self.symbol)[data]
        self.byte = np.append(0, np.flatnonzero(occur) + 1).astype(np.uint16)  # byte + 1 of a symbol, 0 for the end
        self.end = np.cumsum(self.sizes)

    def _read(self, name: str, dtype) -> np.ndarray:
        return np.fromfile(os.path.join(self.folder, name), dtype)

    def _write(self, name: str, x: np.ndarray) -> None:
        x.tofile(os.path.join(self.folder, name))

    def _before(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Symbol before the suffix of so many bytes, at the beginning 0."""
        out = np.zeros(len(rows), self.symbol)
        inside = self.sizes[rows] > size
        out[inside] = self.data[self.end[rows[inside]] - size - 1]
        return out

    @staticmethod
    def _ranks(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by symbol, then as they stand, which is the order of the suffixes one byte longer; the
        place of every row in it."""
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return order, rank

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        """Write the transform (a symbol a row) and the common prefixes (uint8, that of a row and the row
        above it), and read them when all rounds are done; of a symbol its byte + 1, of an end 0."""
        count = len(self.strings)
        active, row = np.arange(count), np.arange(count)  # row of the last inserted suffix of each active string
        self._write("bwt", self._before(active, 0))
        self._write("lcp", np.zeros(count, np.uint8))
        for size in range(1, int(self.sizes.max(initial=0)) + 1):
            bwt, lcp = self._read("bwt", self.symbol), self._read("lcp", np.uint8)
            on = self.sizes[active] >= size
            active, row = active[on], row[on]
            order, rank = self._ranks(bwt)
            ended = len(bwt) - np.count_nonzero(bwt)
            place = rank[row].astype(np.int64)  # among all symbols
            symbol = bwt[row]
            above, below = np.maximum(place - 1, 0), np.minimum(place + 1, len(order) - 1)
            has_above = (place > 0) & (bwt[order[above]] == symbol)
            has_below = (place + 1 < len(order)) & (bwt[order[below]] == symbol)
            common = np.zeros(len(row), np.int64)
            common[has_above] = 1 + self._least(lcp, order[above[has_above]], row[has_above])
            common_below = 1 + self._least(lcp, row[has_below], order[below[has_below]])
            to = count + place - ended
            old = np.ones(len(bwt) + len(row), bool)
            old[to] = False
            grown_bwt, grown_lcp = np.empty(len(old), self.symbol), np.empty(len(old), np.uint8)
            grown_bwt[old], grown_lcp[old] = bwt, lcp
            grown_lcp[to[has_below] + 1] = common_below
            grown_bwt[to], grown_lcp[to] = self._before(active, size), common
            self._write("bwt", grown_bwt)
            self._write("lcp", grown_lcp)
            row = to
        return self.byte[self._read("bwt", self.symbol)], self._read("lcp", np.uint8)

    @staticmethod
    def _least(lcp: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes in two rows: the least between them."""
        if not len(upper):
            return np.zeros(0, np.int64)
        pairs = np.column_stack((upper + 1, lower + 1)).ravel()
        padded = np.append(lcp, np.uint8(0))
        order = np.argsort(upper, kind="stable")
        out = np.empty(len(upper), np.int64)
        out[order] = np.minimum.reduceat(padded, pairs.reshape(-1, 2)[order].ravel())[::2]
        return out

    def rows(self, bwt: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, strings, their rows) of all suffixes of at least so many bytes."""
        count, ended = len(self.strings), len(bwt) - np.count_nonzero(bwt)
        _, rank = self._ranks(bwt)
        active, row = np.arange(count), np.arange(count)
        for size in range(1, int(self.sizes.max(initial=0)) + 1):
            on = self.sizes[active] >= size
            active, row = active[on], row[on]
            row = count + rank[row].astype(np.int64) - ended
            if size >= least:
                yield size, active, row


def repeats(strings: list[bytes], doc: np.ndarray, uid: np.ndarray, start: np.ndarray, length: int, folder: str,
            ) -> tuple[np.ndarray, ...]:
    """Spans (doc, uid, a, b) of the windows of the strings that are not the earliest of their kind.
    start: where in its document each string begins."""
    collection = Collection(strings, folder)
    bwt, lcp = collection.build()
    kind = np.cumsum(lcp < length)
    found = [(kind[row], active, start[active] + collection.sizes[active] - size) for size, active, row in collection.rows(bwt, length)]
    kinds, owner, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, uid[owner], doc[owner], kinds))
    kinds, owner, at = kinds[order], owner[order], at[order]
    new = changes(kinds)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    # a place that two strings hold is one place, not a copy of itself
    later = ~new & ~((doc[owner] == doc[owner[first]]) & (uid[owner] == uid[owner[first]]) & (at == at[first]))
    owner, at = owner[later], at[later]
    return merge_spans(doc[owner], uid[owner], at, at + length)


def _spans_batch(spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in spans], names=["doc", "uid", "a", "b"])


def _identified(docs: DataFrame) -> DataFrame:
    """doc, uid, text: a document is told by its doc_id and a hash of its content, which any scan
    of the table finds again."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.xxhash64("doc_id", "text").alias("uid"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def find_repeats(docs: DataFrame, length: int = 100, anchor: int = 40, hot: int = 20_000, collection_bytes: int = 2 << 20) -> DataFrame:
    """Spans (doc, uid, a, b) of bytes to remove; those of a document may overlap."""
    spark = docs.sparkSession
    if not 0 < anchor < length <= 160:  # a fragment's common prefixes are counted in bytes of 8 bits
        raise ValueError("0 < anchor < length <= 160")
    parts_n = parallelism(spark)
    source = _identified(docs).select("doc", "uid", "text").filter(F.length("text") >= length)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, gathered, held = Powers(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            firsts, others = Entries.joined(gathered).firsts()
            doc, uid, start, windows = others
            spans = merge_spans(doc, uid, start, start + windows + length - 1)
            part = (mix64(firsts.columns[0] ^ U64(SEED)) % U64(parts_n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            firsts, part = firsts.take(order), part[order]
            bounds = np.searchsorted(part, np.arange(parts_n + 1))
            share = np.linspace(0, len(spans[0]), parts_n + 1).astype(int)
            for p in range(parts_n):
                a, b = bounds[p], bounds[p + 1]
                x, y = share[p], share[p + 1]
                if b > a or y > x:
                    block = pickle.dumps((tuple(c[a:b] for c in firsts.columns), tuple(s[x:y] for s in spans)), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

        for whole in parts:
            for batch in text_slices(whole, "text"):
                data, off = flat_bytes(batch.column("text"))
                doc, uid = (batch.column(c).to_numpy() for c in ("doc", "uid"))
                text, start, windows, fp, content, again = fragments(data, off, length, anchor, powers)
                gathered.append((fp, content, doc[text], uid[text], start.astype(np.int32), windows.astype(np.uint8), again))
                held += len(fp)
                if held >= FLUSH:
                    yield from flush()
                    gathered, held = [], 0
        if held:
            yield from flush()

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one part after the other: what copies cover, and the fragments that go on."""
        names = ["doc", "uid", "a", "b", "fp", "hot"]

        def table(doc, uid, a, b, fp=None, is_hot=None) -> pa.RecordBatch:
            none = pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.bool_())
            more = none if fp is None else (pa.array(signed(fp)), pa.array(is_hot))
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (doc, uid, a, b)), *more], names=names)

        def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            loaded = [pickle.loads(b) for b in blocks]
            firsts, others = Entries.joined([x for x, _ in loaded]).firsts()
            doc, uid, start, windows = others
            own = (doc, uid, start, start + windows.astype(np.int64) + length - 1)
            spans = [np.concatenate([own[i], *(s[i] for _, s in loaded)]) for i in range(4)]
            yield table(*merge_spans(*spans))
            fp, _, doc, uid, start, windows, again = firsts.columns
            group = np.cumsum(changes(fp)) - 1
            distinct = np.bincount(group, minlength=1)
            on = np.flatnonzero((distinct[group] > 1) | again)
            yield table(doc[on], uid[on], start[on], start[on] + windows[on].astype(np.int64) + length - 1, fp[on], distinct[group[on]] > hot)

        for blocks in blocks_by_part(parts):
            yield from done(blocks)

    met = written(dealt_blocks(source.mapInArrow(cut, "part int, block binary"), parts_n).mapInArrow(meet, "doc long, uid long, a long, b long, fp long, hot boolean"), "suffix-fragments")
    covered = met.filter(F.col("fp").isNull()).select("doc", "uid", "a", "b")
    wanted = met.filter(F.col("fp").isNotNull()).groupBy("doc", "uid").agg(F.collect_list(F.struct("a", "b", "fp", "hot")).alias("cuts"))

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the fragments; of hot fingerprints those of each distinct window at its first
        place, and what the other places cover."""
        first: dict[bytes, tuple[int, int, int]] = {}
        later: list[tuple[int, int, int]] = []

        def put(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 20_000):
                columns = zip(*rows[i: i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 5, pa.binary()), strict=True)],
                                                 names=["kind", "key", "doc", "uid", "a", "b", "bytes"])

        def flush() -> Iterator[pa.RecordBatch]:
            yield from put([(HOT, int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), *place, place[2] + length, window)
                            for window, place in first.items()])
            doc, uid, at = np.array(later, np.int64).reshape(-1, 3).T
            spans = zip(*(x.tolist() for x in merge_spans(doc, uid, at, at + length)), strict=True)
            yield from put([(COVERED, uid, doc, uid, a, b, None) for doc, uid, a, b in spans])
            first.clear()
            later.clear()

        for whole in parts:
            for batch in text_slices(whole, "text", 1 << 20):
                rows = []
                for doc, uid, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc", "uid", "text", "cuts")), strict=True):
                    for c in cuts:
                        if not c["hot"]:
                            rows.append((COLD, c["fp"], doc, uid, c["a"], c["b"], text[c["a"]: c["b"]]))
                            continue
                        for a in range(c["a"], c["b"] - length + 1):
                            window, place = text[a: a + length], (doc, uid, a)
                            known = first.setdefault(window, place)
                            if place < known:
                                first[window] = place
                                later.append(known)
                            elif place > known:
                                later.append(place)
                        if len(first) + len(later) >= WINDOWS:
                            yield from flush()
                yield from put(rows)
        yield from flush()

    cut_out = source.join(wanted, ["doc", "uid"]).mapInArrow(extract, "kind int, key long, doc long, uid long, a long, b long, bytes binary")

    def order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            rows, held, last = [], 0, None
            window, earliest = None, None

            def done() -> pa.RecordBatch:
                doc, uid, a = (np.array(x, np.int64) for x in zip(*[r[:3] for r in rows], strict=True))
                return _spans_batch(repeats([r[3] for r in rows], doc, uid, a, length, folder))

            for batch in parts:
                covered = []
                for kind, key, *place, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == COVERED:
                        covered.append((*place, b))
                    elif kind == HOT:  # sorted by content, then by place
                        if text != window:
                            window, earliest = text, place
                        elif place != earliest:
                            covered.append((*place, b))
                    else:
                        if key != last and held >= collection_bytes:
                            yield done()
                            rows, held = [], 0
                        last = key
                        rows.append((*place, text))
                        held += len(text)
                if covered:
                    yield _spans_batch(tuple(np.array(covered, np.int64).T))
            if rows:
                yield done()

    dealt = cut_out.repartition(parts_n, "key").sortWithinPartitions("kind", "key", "bytes", "doc", "uid", "a")
    ordered = dealt.mapInArrow(order, "doc long, uid long, a long, b long")
    return covered.unionAll(ordered)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: what remains)."""
    spans = find_repeats(docs, **options).groupBy("doc", "uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = _identified(docs).join(spans, ["doc", "uid"], "left").select("doc_id", "text", "spans")

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in text_slices(whole, "text"):
                rows = []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    kept, at, removed, runs, far = [], 0, 0, 0, -1
                    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                        if a > far:
                            kept.append(text[at:a])
                            runs += 1
                            removed += b - a
                        elif b > far:
                            removed += b - far
                        far = at = max(far, b)
                    kept.append(text[at:])
                    rows.append((len(text), removed, runs, b"".join(kept)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")

"""Line dedup by a segment-partition edit join.

A line (what stands between line feeds) of at least ``min_chars`` code points goes when an equal line
or one within ``max_edits`` edits (insert, delete, replace a code point) stands earlier: in a
document of smaller doc_id, or further up in the same document. All judged on the input. Shorter
lines stay, unless ``equal_chars`` is given: then lines of at least so many code points that are not
blank go when an equal one stands earlier, and ``min_chars`` bounds the edit join only.

Distinct lines are split into ``max_edits + 1`` segments; of two lines within so many edits, one
segment of the shorter is a substring of the longer, at a place that the lengths and the segment's
number bound. Segments are indexed, and the possible substrings probed, by hash of (length, segment
number, characters). Pairs that meet there and whose counts of characters (eight classes, four bits
each) do not differ by more than the edits could are verified by a bit-parallel edit distance over
the band of ``2 * max_edits + 1`` diagonals.

Equal lines are taken together first, within a scan task and then over all. A key that more than
``hot`` indexed lines share is split into squares of index and probe blocks, dealt to tasks of their
own.

Defined results: null text counts as empty and stays null; null doc_id comes first, rows of equal
doc_id and different text are ordered by a hash, rows equal in both are one document and get one
result; very long lines are compared as a whole; an empty table gives no rows; all columns pass
through, also those named like a result, unless asked for.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pressroom.llm.common import U64, blocks_by_part, changes, dealt_blocks, mix64, parallelism, signed, text_slices, unsigned, written

SEED = 2
NULL_ID = -(2**63)  # stands for a null doc_id
FLUSH = 500_000  # keys that a scan task gathers before it passes them on
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 2**64)
REMOVED, LINE, PAIR, HOT_INDEX, HOT_PROBE = range(5)
BLOCK_PAIRS = 1_000_000
NO_KEYS = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32)


def segments(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of these sizes: equal parts, longer ones last."""
    base, longer = size // (edits + 1), size % (edits + 1)
    before = np.maximum(0, i - (edits + 1 - longer))
    return i * base + before, base + (i >= edits + 1 - longer)


def line_keys(lines: list[str], edits: int, min_chars: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(keys, line numbers) to index and to probe, and the character counts of each line."""
    size = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate(([0], np.cumsum(size)))
    value = mix64(points.astype(U64) + U64(SEED))
    n = len(points)
    up = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, MULTIPLIER, U64))))
    down = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, INVERSE, U64))))
    h = np.concatenate((np.zeros(1, U64), np.cumsum(value * up[:n])))
    line = np.repeat(np.arange(len(lines)), size)
    counts = np.bincount(line * 8 + (value & U64(7)).astype(np.int64), minlength=8 * len(lines)).reshape(-1, 8)
    sketch = ((counts & 15).astype(np.uint32) << (4 * np.arange(8, dtype=np.uint32))).sum(1).astype(np.uint32)

    def key(start: np.ndarray, length: np.ndarray, of_size: np.ndarray, i: int) -> np.ndarray:
        return mix64(mix64((h[start + length] - h[start]) * down[start]) + of_size.astype(U64) * U64(64) + U64(i))

    numbers = np.arange(len(lines))
    index, probe = [], []
    for i in range(edits + 1):
        start, length = segments(size, i, edits)
        index.append((key(off[:-1] + start, length, size, i), numbers))
        for delta in range(edits + 1):
            of = size - delta
            start, length = segments(of, i, edits)
            low = np.maximum(start - i, start + delta - (edits - i))
            high = np.minimum(start + i, start + delta + (edits - i))
            for shift in range(2 * edits + 1):
                at = low + shift
                fit = np.flatnonzero((of >= min_chars) & (at <= high) & (at >= 0) & (at + length <= size))
                if len(fit):
                    probe.append((key(off[fit] + at[fit], length[fit], of[fit], i), fit))
    return tuple(np.concatenate(x) for x in zip(*index, strict=True)), tuple(np.concatenate(x) for x in zip(*probe, strict=True)), sketch


def may_match(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether the character counts leave so few edits possible (an edit moves two counts by one)."""
    total = np.zeros(len(a), np.uint32)
    for k in range(8):
        d = ((a >> np.uint32(4 * k)) - (b >> np.uint32(4 * k))) & np.uint32(15)
        total += np.minimum(d, 16 - d)
    return total <= 2 * edits


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair is within so many edits: a column of the band at a time, as bits of one
    word per pair, over all pairs at once. The word's top bit is the lowest diagonal of the band."""
    out = np.zeros(len(pairs), bool)
    swapped = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    order = sorted((i for i, (a, b) in enumerate(swapped) if len(a) - len(b) <= edits and len(a) > edits), key=lambda i: len(swapped[i][0]))
    for i in (i for i, (a, _) in enumerate(swapped) if len(a) <= edits):
        out[i] = True  # replacing all characters is enough
    while order:
        widest = len(swapped[order[-1]][0])
        part = order[-max(1, 2_000_000 // (widest + 2 * edits + 1)):]
        del order[-len(part):]
        rows, cols = np.array([len(swapped[i][0]) for i in part]), np.array([len(swapped[i][1]) for i in part])

        def matrix(which: int, before: int, width: int, fill: int, part: list[int] = part) -> np.ndarray:
            m = np.full((len(part), width), fill, np.uint32)
            for r, i in enumerate(part):
                x = np.frombuffer(swapped[i][which].encode("utf-32-le", "surrogatepass"), np.uint32)
                m[r, before: before + len(x)] = x
            return np.ascontiguousarray(m.T)

        first = matrix(0, edits, widest + 3 * edits + 2, 0xFFFFFFFF)
        second = matrix(1, 0, int(cols.max()), 0xFFFFFFFE)
        top, one = U64(63), U64(1)
        vp = np.full(len(part), (2**64 - 1) << (63 - edits) & (2**64 - 1), U64)
        vn, last_bit = np.zeros(len(part), U64), np.full(len(part), 62, U64)
        distance = np.full(len(part), edits, np.int64)
        for j in range(len(second)):
            same = np.zeros(len(part), U64)
            for k in range(2 * edits + 1):  # row j - edits + k of the band
                same |= (first[j + k] == second[j]).astype(U64) << (top - U64(2 * edits - k))
            d0 = (((same & vp) + vp) ^ vp) | same | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            live, down = j < cols, j < rows - edits  # down the lowest diagonal, then along the last row
            along = live & ~down
            distance += np.where(down & live, 1 - (d0 >> top).astype(np.int64), 0)
            distance += np.where(along, ((hp >> last_bit) & one).astype(np.int64) - ((hn >> last_bit) & one).astype(np.int64), 0)
            last_bit = np.where(along, last_bit - one, last_bit)
            vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        out[part] = distance <= edits
    return out


def _candidates(index: tuple[np.ndarray, ...], probe: tuple[np.ndarray, ...], edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs (smaller, larger node) of index and probe entries (key, node, counts) with one
    key, in blocks of bounded size. index is sorted by key."""
    low, high = np.searchsorted(index[0], probe[0], "left"), np.searchsorted(index[0], probe[0], "right")
    many = high - low
    use = np.flatnonzero(many)
    ends = np.cumsum(many[use])
    at = 0
    while at < len(use):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_PAIRS, "right")))
        rows = use[at:to]
        p = np.repeat(rows, many[rows])
        i = np.arange(len(p)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows]) + np.repeat(low[rows], many[rows])
        a, b = index[1][i], probe[1][p]
        fit = (a != b) & may_match(index[2][i], probe[2][p], edits)
        both = np.unique(np.column_stack((np.minimum(a, b)[fit], np.maximum(a, b)[fit])), axis=0)
        if len(both):
            yield both[:, 0], both[:, 1]
        at = to


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.xxhash64("doc_id", "text").alias("uid"), "text")


NAMES = ["kind", "a", "b", "c", "d", "e"]
ROWS = "kind int, a long, b long, c long, d long, e long"


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    columns = [*columns, *[np.zeros(n, np.int64)] * (5 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(c, np.int64)) for c in columns)], names=NAMES)


def _line_table(docs: DataFrame, edits: int, min_chars: int, hot: int, equal_chars: int) -> DataFrame:
    """Rows of kind REMOVED (doc, uid, line: equal to an earlier one), LINE (node, its other hash half,
    doc, uid, line of each distinct line's first place), PAIR (nodes), and, of keys with more than
    ``hot`` indexed lines, HOT_INDEX and HOT_PROBE (key, node, counts)."""
    parts_n = parallelism(docs.sparkSession)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int, int]] = {}
        gathered: list[tuple] = []
        again: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            halves = np.frombuffer(b"".join(first), np.int64).reshape(-1, 2)
            places = np.array(list(first.values()), np.int64).reshape(-1, 3)
            home = (mix64(unsigned(halves[:, 0])) % U64(parts_n)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            lines, home = np.column_stack((halves, places))[order], home[order]
            out = [(lines, np.searchsorted(home, np.arange(parts_n + 1)))]
            for side in (0, 1):
                key, node, count = (np.concatenate([none, *(g[side][k] for g in gathered)]) for k, none in enumerate(NO_KEYS))
                part = (key % U64(parts_n)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                out.append(((key[order], node[order], count[order]), np.searchsorted(part[order], np.arange(parts_n + 1))))
            removed = np.array(again, np.int64).reshape(-1, 3)
            share = np.linspace(0, len(removed), parts_n + 1).astype(int)
            for p in range(parts_n):
                cuts = [slice(at[p], at[p + 1]) for _, at in out]
                if any(c.stop > c.start for c in cuts) or share[p + 1] > share[p]:
                    block = pickle.dumps((out[0][0][cuts[0]], tuple(x[cuts[1]] for x in out[1][0]), tuple(x[cuts[2]] for x in out[2][0]), removed[share[p]: share[p + 1]]), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

        held = 0
        for whole in parts:
            for batch in text_slices(whole, "text"):
                new: dict[bytes, str] = {}
                for doc, uid, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "uid", "text")), strict=True):
                    for number, line in enumerate((text or "").split("\n")):
                        short = len(line) < min_chars
                        if short and (len(line) < equal_chars or not line.strip()):
                            continue
                        digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        place, known = (doc, uid, number), first.get(digest)
                        if known is None:
                            first[digest] = place
                            if short:
                                held += 1
                            else:
                                new[digest] = line
                        elif place < known:
                            first[digest] = place
                            again.append(known)
                        elif place > known:
                            again.append(place)
                if new:
                    node = np.ascontiguousarray(np.frombuffer(b"".join(new), np.int64).reshape(-1, 2)[:, 0])
                    index, probe, count = line_keys(list(new.values()), edits, min_chars)
                    gathered.append(tuple((key, node[at], count[at]) for key, at in (index, probe)))
                    held += len(probe[0])
                if held >= FLUSH:
                    yield from flush()
                    first, gathered, again, held = {}, [], [], 0
        if first:
            yield from flush()

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            loaded = [pickle.loads(b) for b in blocks]
            removed = np.concatenate([x[3] for x in loaded])
            yield _rows(REMOVED, *removed.T)
            lines = np.concatenate([x[0] for x in loaded])
            lines = lines[np.lexsort(lines.T[::-1])]
            new = changes(lines[:, 0], lines[:, 1])
            yield _rows(LINE, *lines[new].T)
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            moved = ~new & (lines[:, 2:] != lines[at, 2:]).any(1)  # the same place of a repeated row is no copy
            yield _rows(REMOVED, *lines[moved][:, 2:].T)
            sides = []
            for side in (1, 2):
                key, node, count = (np.concatenate([x[side][k] for x in loaded]) for k in range(3))
                order = np.lexsort((node, key))
                key, node, count = key[order], node[order], count[order]
                once = changes(key, node)
                sides.append((key[once], node[once], count[once]))
            index, probe = sides
            names, sizes = np.unique(index[0], return_counts=True)
            large = names[sizes > hot]
            for kind, side in ((HOT_INDEX, index), (HOT_PROBE, probe)):
                rows = np.isin(side[0], large)
                yield _rows(kind, signed(side[0][rows]), side[1][rows], side[2][rows].astype(np.int64))
            index, probe = (tuple(x[~np.isin(side[0], large)] for x in side) for side in (index, probe))
            for a, b in _candidates(index, probe, edits):
                yield _rows(PAIR, a, b)

        for blocks in blocks_by_part(parts):
            yield from done(blocks)

    blocks = dealt_blocks(_identified(docs).mapInArrow(cut, "part int, block binary"), parts_n)
    return written(blocks.mapInArrow(meet, ROWS), "lines")


def _hot_pairs(table: DataFrame, edits: int, hot: int) -> DataFrame:
    """The pairs (a, b) of the hot keys, a square of an index and a probe block per group."""
    sides = {k: table.filter(F.col("kind") == k).select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("c").alias("count")) for k in (HOT_INDEX, HOT_PROBE)}
    blocks = {k: side.groupBy("key").agg(F.ceil(F.count("*") / hot).alias(f"blocks_{k}")) for k, side in sides.items()}
    counted = blocks[HOT_INDEX].join(blocks[HOT_PROBE], "key")
    dealt = []
    for k, other in ((HOT_INDEX, HOT_PROBE), (HOT_PROBE, HOT_INDEX)):
        own = F.pmod(F.xxhash64("node"), F.col(f"blocks_{k}")).cast("int")
        every = F.explode(F.sequence(F.lit(0), (F.col(f"blocks_{other}") - 1).cast("int")))
        side = sides[k].join(counted, "key").select("key", "node", "count", own.alias("own"), every.alias("other"))
        x, y = ("own", "other") if k == HOT_INDEX else ("other", "own")
        dealt.append(side.select("key", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(k).alias("side"), "node", "count"))

    def squares(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {HOT_INDEX: [], HOT_PROBE: []}

        def done() -> Iterator[pa.RecordBatch]:
            sides = []
            for k in (HOT_INDEX, HOT_PROBE):
                node, count = (np.array(x, t) for x, t in zip(zip(*held[k], strict=True), (np.int64, np.uint32), strict=True)) if held[k] else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                sides.append((np.zeros(len(node), U64), node, count))
            for a, b in _candidates(*sides, edits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in parts:
            for key, x, y, side, node, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, x, y) != now and now is not None:
                    yield from done()
                    held = {HOT_INDEX: [], HOT_PROBE: []}
                now = (key, x, y)
                held[side].append((node, count))
        if now is not None:
            yield from done()

    both = dealt[0].unionAll(dealt[1])
    return both.repartition(parallelism(table.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(squares, "a long, b long")


def _similar(docs: DataFrame, table: DataFrame, edits: int, hot: int) -> DataFrame:
    """(doc, uid, line): first places of lines that have a similar line earlier."""
    pairs = table.filter(F.col("kind") == PAIR).select("a", "b").unionAll(_hot_pairs(table, edits, hot))
    pairs = written(pairs.distinct(), "line-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    lines = table.filter(F.col("kind") == LINE).select(F.col("a").alias("node"), F.col("c").alias("doc"), F.col("d").alias("uid"), F.col("e").alias("line"))
    wanted = lines.join(nodes, "node").groupBy("doc", "uid").agg(F.collect_list(F.struct("line", "node")).alias("wanted"))

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in text_slices(whole, "text", 2 << 20):
                rows = []
                for doc, uid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "uid", "text", "wanted")), strict=True):
                    split = (text or "").split("\n")
                    rows.extend((w["node"], doc, uid, w["line"], split[w["line"]]) for w in wanted)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()), strict=True)], names=["node", "doc", "uid", "line", "text"])

    texts = (_identified(docs).join(wanted, ["doc", "uid"]).mapInArrow(fetch, "node long, doc long, uid long, line long, text string")
             .dropDuplicates(["node", "doc", "uid", "line"]))
    texts = written(texts, "line-texts")
    a, b = (texts.select(F.col("node").alias(c), F.struct("doc", "uid", "line").alias(f"place_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in text_slices(whole, "text_a", 1 << 20):
                good = within(list(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)), edits)
                yield batch.select(["doc", "uid", "line"]).filter(pa.array(good))

    later = F.greatest("place_a", "place_b")
    joined = pairs.join(a, "a").join(b, "b").select(later["doc"].alias("doc"), later["uid"].alias("uid"), later["line"].alias("line"), "text_a", "text_b")
    return joined.mapInArrow(verify, "doc long, uid long, line long")


def removed_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 30, hot: int = 4096, equal_chars: int | None = None) -> DataFrame:
    """(doc, uid, line from 0) of every line that goes; may name a line twice."""
    if not 0 <= max_edits <= 15 or min_chars <= max_edits:
        raise ValueError("max_edits up to 15 and below min_chars")
    table = _line_table(docs, max_edits, min_chars, hot, min_chars if equal_chars is None else equal_chars)
    equal = table.filter(F.col("kind") == REMOVED).select(F.col("a").alias("doc"), F.col("b").alias("uid"), F.col("c").alias("line"))
    return equal.unionAll(_similar(docs, table, max_edits, hot))


def dedup_lines(docs: DataFrame, report: bool = False, **options) -> DataFrame:
    """All rows and columns, ``text`` without the lines that go. report: also n_lines and
    removed_lines (their numbers from 0); columns of these names are replaced then."""
    names = ("n_lines", "removed_lines") if report else ()
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    gone = removed_lines(docs, **options).groupBy("doc", "uid").agg(F.collect_set("line").alias("gone"))
    columns = source.columns
    packed = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("uid"),
                           F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    flat = packed.join(gone, ["doc", "uid"], "left").select(*[F.col("row")[f"c{i}"].alias(f"c{i}") for i in range(len(columns))], "gone")
    text = columns.index("text")
    schema = StructType([*source.schema.fields, *([StructField("n_lines", LongType()), StructField("removed_lines", ArrayType(LongType()))] if report else [])])

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in text_slices(whole, f"c{text}"):
                kept, counts, gone_now = [], [], []
                for value, gone in zip(batch.column(text).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                    split = (value or "").split("\n")
                    drop = set(gone or ())
                    kept.append("\n".join(x for i, x in enumerate(split) if i not in drop) if drop else value)
                    counts.append(0 if value is None else len(split))
                    gone_now.append(sorted(drop))
                out = [pa.array(kept, pa.string()) if i == text else batch.column(i) for i in range(len(columns))]
                more = [pa.array(counts, pa.int64()), pa.array(gone_now, pa.list_(pa.int64()))] if report else []
                yield pa.RecordBatch.from_arrays([*out, *more], names=[*columns, *names])

    return flat.mapInArrow(apply, schema)

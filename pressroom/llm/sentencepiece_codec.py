"""SentencePiece encoding and decoding by a streaming Viterbi search over the piece lattice.

The search goes over the text once. Of each position it keeps the best way there (piece and
backpointer); a new piece may begin at any of the last ``max_piece`` positions, so only the
paths from these are alive. Whenever the backpointers of all live paths meet at one boundary, the
ids before it are committed and their nodes dropped, so memory does not grow with the text.

Two kinds of model, which differ in what makes a path best:

* ``unigram``: the largest sum of piece scores (an earlier find wins a tie).
* ``bpe``: the path that the merges would leave. A sequence of pieces is the result of the merges
  exactly if every piece, and every pair of neighbours, merges back into itself; so an edge is
  open where the piece is stable after the piece before it, and of each prefix one path survives.
  Summing the scores of such a model would not give its ids.

Characters outside the vocabulary become their UTF-8 bytes where the model has byte pieces, else
``unk``. Text is prefixed with a space and spaces are written as U+2581; no other normalisation.
Where no piece holds U+2581 after another character (checked on the vocabulary), all paths of any
text meet before such a mark, so the stretches between two of these boundaries are searched on
their own, and the ids of short ones are memoised in a bounded table. For ``bpe`` the short
stretches of a batch are searched in lockstep, one position of all of them at a time, with the same
edges and the same rule; longer ones, runs of spaces and unknown characters go through
:meth:`Codec.stream`.

Defined results: null and empty texts have no ids; U+2581 in a text is taken for a space, so such
a text comes back with spaces (``round_trip`` false); very long words go through the same window.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from pressroom.llm.common import text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MEMO = 300_000  # memoised stretches a task holds
MEMO_CHARS = 64


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, type) by id; type is normal, byte, control or unknown."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i), "unknown" if model.is_unknown(i) else "control" if model.is_control(i)
             else "byte" if model.is_byte(i) else "normal") for i in range(model.get_piece_size())]


class LockstepTables:
    """The trie, the merges and the ranks of a ``bpe`` vocabulary as sorted arrays, to search many
    stretches at once. ``usable`` is false if some piece ranks before a piece it is merged from;
    the rule below needs that order, so such a vocabulary is searched by :meth:`Codec.stream`."""

    def __init__(self, codec: Codec):
        self.max_piece, n = codec.max_piece, max(codec.ids.values(), default=0) + 1
        self.single = frozenset(p for p in codec.ids if len(p) == 1)
        rank = np.full(n + 1, np.inf)
        left, right = np.full(n + 1, n, np.int64), np.full(n + 1, n, np.int64)  # n: nothing
        self.stable = np.zeros(n + 1, bool)
        self.usable = True
        joins: dict[int, int] = {}
        for piece, i in codec.ids.items():
            rank[i] = -codec.scores[piece]
            whole, halves = codec.merge_tree(piece)
            self.stable[i] = whole
            if whole and halves:
                left[i], right[i] = codec.ids.get(halves[0], n), codec.ids.get(halves[1], n)
            for k in range(1, len(piece)):
                a, b = codec.ids.get(piece[:k]), codec.ids.get(piece[k:])
                if a is not None and b is not None:
                    joins[a * n + b] = i
                    if SPACE * 2 not in piece and max(-codec.scores[piece[:k]], -codec.scores[piece[k:]]) >= rank[i] and self.stable[i] \
                            and halves == (piece[:k], piece[k:]) and min(k, len(piece) - k) > 1:
                        self.usable = False
        self.n, self.rank, self.left, self.right = n, rank, left, right
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        nodes, keys, children, pieces = 1, [], [], [-1]
        todo = [(0, codec.trie)]
        while todo:
            at, branch = todo.pop()
            for c, below in branch.items():
                if c:
                    keys.append(at << 21 | ord(c))
                    children.append(nodes)
                    pieces.append(codec.ids[below[""]] if "" in below else -1)
                    todo.append((nodes, below))
                    nodes += 1
        order = np.argsort(np.array(keys, np.int64))
        self.trie_keys, self.trie_children = np.array(keys, np.int64)[order], np.array(children, np.int64)[order]
        self.node_piece = np.array(pieces, np.int64)
        self.node_piece[(self.node_piece >= 0) & ~self.stable[self.node_piece]] = -1

    def plain(self, part: str) -> bool:
        return self.single.issuperset(part)

    def unstable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of a + b would cross the boundary: some part at the end of a and some
        part at the beginning of b are merged before either is taken into what it is a part of."""
        out = np.zeros(len(a), bool)
        at, taken = a, np.full(len(a), np.inf)
        rows = np.arange(len(a))
        while len(rows):
            to, taken_b, sub = b[rows], np.full(len(rows), np.inf), np.arange(len(rows))
            while len(sub):
                key = at[sub] * self.n + to
                i = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
                r = np.where(self.join_keys[i] == key, self.rank[self.join_ids[i]], np.inf)
                out[rows[sub]] |= (r < taken[sub]) & (r <= taken_b) & np.isfinite(r)
                taken_b, to = self.rank[to], self.left[to]
                more = to < self.n
                sub, to, taken_b = sub[more], to[more], taken_b[more]
            taken, at = self.rank[at], self.right[at]
            more = (at < self.n) & ~out[rows]
            rows, at, taken = rows[more], at[more], taken[more]
        return out

    def search(self, parts: list[str]) -> list[bytes]:
        """The ids of each stretch, as int32 bytes."""
        if not parts:
            return []
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        off = np.concatenate(([0], np.cumsum(lengths)))
        part = np.repeat(np.arange(len(parts)), lengths)
        stop = off[1:][part]
        begins, ends, pieces = [], [], []
        start = np.arange(len(points))
        node, at = np.zeros(len(points), np.int64), start
        for _ in range(self.max_piece):
            key = node << 21 | points[at]
            i = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            found = self.trie_keys[i] == key
            start, at, node = start[found], at[found] + 1, self.trie_children[i[found]]
            piece = self.node_piece[node]
            is_piece = piece >= 0
            begins.append(start[is_piece])
            ends.append(at[is_piece])
            pieces.append(piece[is_piece])
            more = at < stop[start]
            start, at, node = start[more], at[more], node[more]
            if not len(start):
                break
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        place = begin - off[part[begin]]
        order = np.argsort(place, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        steps = np.searchsorted(place[order], np.arange(int(lengths.max()) + 1))
        begin, end = begin + part[begin], end + part[begin]  # a stretch of n characters has n + 1 boundaries
        first = off[:-1] + np.arange(len(parts))
        last = np.full(len(points) + len(parts), -1, np.int64)  # the piece that ends here, -1: not reached
        last[first] = self.n
        back = np.zeros(len(last), np.int64)
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            before = last[begin[a:b]]
            e = np.flatnonzero(before >= 0)
            before, after = before[e], piece[a:b][e]
            check = np.flatnonzero(before < self.n)
            pairs, which = np.unique(before[check] * self.n + after[check], return_inverse=True)
            crossed = np.zeros(len(e), bool)
            crossed[check] = self.unstable(pairs // self.n, pairs % self.n)[which]
            e = e[~crossed] + a
            last[end[e]] = piece[e]
            back[end[e]] = begin[e]
        rows, at, taken = np.arange(len(parts)), first + lengths, []
        count = np.zeros(len(parts), np.int64)
        while len(rows):
            taken.append((rows, count[rows], last[at]))
            count[rows] += 1
            at = back[at]
            more = at > first[rows]
            rows, at = rows[more], at[more]
        to = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(int(to[-1]), np.int32)
        for rows, step, found in taken:
            ids[to[rows] + count[rows] - 1 - step] = found
        flat, cut = ids.tobytes(), (4 * to).tolist()
        return [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, str]], kind: str = "bpe", tables: LockstepTables | None = None):
        if kind not in ("bpe", "unigram"):
            raise ValueError("kind: bpe or unigram")
        self.bpe = kind == "bpe"
        self.scores = {p: s for p, s, t in vocabulary if t == "normal"}
        self.ids = {p: i for i, (p, _, t) in enumerate(vocabulary) if t == "normal"}
        self.unknown = next((i for i, x in enumerate(vocabulary) if x[2] == "unknown"), 0)
        self.byte_ids = [next((i for i, x in enumerate(vocabulary) if x[2] == "byte" and x[0] == f"<0x{b:02X}>"), None) for b in range(256)] \
            if any(x[2] == "byte" for x in vocabulary) else None
        self.max_piece = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        self.trie: dict = {}
        for piece in self.ids:
            at = self.trie
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = piece
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        held = set("".join(self.ids))
        alone = "".join(c for c in "\n\t\r\0" if c not in held)  # in no piece: a boundary on either side
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone))
        self.stable: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.tables = tables
        self.out = [p.replace(SPACE, " ").encode() if t == "normal" else bytes([int(p[3:5], 16)]) if t == "byte"
                    else " ⁇ ".encode() if t == "unknown" else b"" for p, _, t in vocabulary]

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The merges carried out on a short text, until so many parts are left."""
        parts, scores = list(text), self.scores
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_tree(self, piece: str) -> tuple[bool, tuple[str, str] | None]:
        """Whether a piece merges into itself, and the two parts of its last merge."""
        if len(piece) == 1:
            return True, None
        for k in range(1, len(piece)):
            halves = (piece[:k], piece[k:])
            if all(len(h) == 1 or h in self.scores for h in halves) and self.merged(piece, until=2) == list(halves):
                return self.merged(piece) == [piece], halves
        return False, None

    def follows(self, before: str, piece: str) -> bool:
        """Whether ``piece`` is stable after ``before`` (empty: at a beginning or after a
        character outside the vocabulary)."""
        key = (before, piece)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            known = self.stable[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def stream(self, characters: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text given character by character, as they are committed."""
        text: list[str] = []  # characters from the committed boundary on
        way: list[tuple[float, int, str, int] | None] = [(0.0, -1, "", -1)]  # of each position: score, start, piece ("" unknown), id
        live: list[tuple[int, dict]] = [(0, self.trie)]  # beginnings with their place in the trie
        check = 4 * self.max_piece
        for c in characters:
            text.append(c)
            here = len(text)
            best = None
            nxt = []
            for start, at in live:
                at = at.get(c)
                if at is None:
                    continue
                nxt.append((start, at))
                piece = at.get("")
                if piece is not None:
                    before = way[start]
                    if self.bpe:
                        if best is None and self.follows(before[2], piece):
                            best = (0.0, start, piece, self.ids[piece])
                    elif best is None or before[0] + self.scores[piece] > best[0]:
                        best = (before[0] + self.scores[piece], start, piece, self.ids[piece])
            if c not in self.ids and (best is None or not self.bpe and way[here - 1] and way[here - 1][0] + self.worst > best[0]) and way[here - 1]:
                best = (way[here - 1][0] + self.worst, here - 1, "", -1)
            way.append(best)
            live = nxt
            if best is not None:
                live.append((here, self.trie))
            if here >= check:
                cut = self._meet(way, {start for start, _ in live})
                if cut > 0:
                    yield self._ids(text, way, cut)
                    del text[:cut]
                    way = [(0.0, -1, way[cut][2], -1)] + [w and (w[0] - way[cut][0], w[1] - cut, w[2], w[3]) for w in way[cut + 1:]]
                    live = [(start - cut, at) for start, at in live]
                check = len(text) + 4 * self.max_piece
        if text:
            yield self._ids(text, way, len(text))

    @staticmethod
    def _meet(way: list, ends: set[int]) -> int:
        """The boundary that the backpointers of all these positions share."""
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(way[last][1])
        return ends.pop()

    def _ids(self, text: list[str], way: list, end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            _, start, _, number = way[end]
            if number >= 0:
                out.append(number)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[start].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def _stretch(self, part: str) -> bytes:
        found = np.array([i for ids in self.stream(part) for i in ids], np.int32).tobytes()
        if len(part) <= MEMO_CHARS:
            self.memo[part] = found
        return found

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        parts = [self.stretch.findall(t) if self.cuts else [t] if t else [] for t in marked]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if self.tables and self.cuts:
            new = {p for x in parts for p in x}.difference(self.memo)
            fit = [p for p in new if len(p) <= MEMO_CHARS and p[:2] != SPACE + SPACE and self.tables.plain(p)]
            self.memo.update(zip(fit, self.tables.search(fit), strict=True))
        known, new = self.memo.get, self._stretch
        return [np.frombuffer(b"".join([known(p) or new(p) for p in x]), np.int32) for x in parts]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def lockstep_tables(vocabulary: list[tuple[str, float, str]], kind: str = "bpe") -> LockstepTables | None:
    tables = LockstepTables(Codec(vocabulary)) if kind == "bpe" else None
    return tables if tables and tables.usable and len(tables.join_keys) else None


def encode_documents(docs: DataFrame, model: str = MODEL, kind: str = "bpe", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int), n_ids and round_trip (the ids decode to the text again) to every
    row; columns of these names are replaced, all others pass through."""
    spark: SparkSession = docs.sparkSession
    listed = load_vocabulary(model)
    tables = lockstep_tables(listed, kind)
    shared = spark.sparkContext.broadcast((listed, tables))  # as large as the vocabulary, whatever the data
    names = (ids, "n_ids", "round_trip")
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    schema = StructType([*source.schema.fields, StructField(ids, ArrayType(IntegerType(), False)),
                         StructField("n_ids", LongType()), StructField("round_trip", BooleanType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value[0], kind, shared.value[1])
        for whole in parts:
            for part in text_slices(whole, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                found = codec.encode_many(texts)
                lengths = np.array([len(f) for f in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                same = [codec.decode(f.tolist()) == (t or "") for f, t in zip(found, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(lengths), pa.array(same)], names=[*part.schema.names, *names])

    return source.mapInArrow(batches, schema)

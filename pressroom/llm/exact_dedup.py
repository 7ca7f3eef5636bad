"""Exact dedup with Patricia-trie owners.

Texts (A-Z lower-cased, UTF-8) are dealt by length and content hash; each partition inserts the
full byte strings into a compressed radix trie, whose terminal nodes hold the owner, the smallest
identifier by the chosen order. Two levels:

1. Every scan task inserts its own texts first, so a group of copies leaves a task as one string,
   however large it is; each row remembers its local class.
2. The local classes are dealt by (length, hash) and inserted again; the terminal nodes then name
   the owner of each class, and rows take it over by their local class, of which no task's share
   is more than one scan task's rows.

A trie that outgrows its budget (labels and what Python takes for nodes, terminals and classes) spills
its largest subtree to a file of the task, takes further strings of that subtree there unread, and
works the file off as a trie of its own at the end. The files belong to the running task and go with
it; a task that is run anew makes its own. In level 1 a full trie is passed on and begun anew: a text
may then leave a task more than once, which level 2 puts right.

Defined results: null text counts as empty (all such rows are one group); null doc_id orders
before all others; of rows with equal text and equal doc_id one stays (the first read); very long
texts are whole strings like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import parallelism, written

BUDGET = 64 << 20  # bytes that a trie keeps in memory, by the costs below
# What Python takes, in bytes (as tracemalloc measures it): a node with its label's header, its dict of
# children and its place in its parent's; a terminal with key, list and numbers; a class in it; a digest.
NODE, TERMINAL, CLASS, DIGEST = 200, 200, 40, 220


class Node:
    __slots__ = ("label", "children", "end")

    def __init__(self, label: bytes):
        self.label, self.children, self.end = label, {}, None


class Terminal:
    """A distinct string: its owner (smallest key), rows, and the classes that it takes in."""

    __slots__ = ("key", "rows", "classes")

    def __init__(self, key, rows, classes):
        self.key, self.rows, self.classes = key, rows, classes

    def take(self, key, rows, classes) -> None:
        self.key = min(self.key, key)
        self.rows += rows
        self.classes += classes


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings, with spill by subtree."""

    def __init__(self, budget: int = BUDGET, skip: int = 0):
        self.root, self.budget, self.skip = Node(b""), budget, skip
        self.bytes = 0  # of labels, nodes, terminals and classes below the root
        self.by_first: dict[int, int] = {}  # the same under each child of the root
        self.spilled: dict[int, object] = {}

    def insert(self, text: bytes, key, rows: int, classes: list) -> Terminal | None:
        """Add a string; its terminal node, or None if it went to a spilled subtree."""
        i = self.skip
        first = text[i] if len(text) > i else -1
        if first in self.spilled:
            pickle.dump((text, key, rows, classes), self.spilled[first], 5)
            return None
        node = self.root
        while True:
            if i == len(text):
                if node.end is None:
                    node.end = Terminal(key, rows, classes)
                    self._held(first, TERMINAL + CLASS * len(classes))
                else:
                    node.end.take(key, rows, classes)
                    self._held(first, CLASS * len(classes))
                return node.end
            child = node.children.get(text[i])
            if child is None:
                child = Node(text[i:])
                child.end = Terminal(key, rows, classes)
                node.children[text[i]] = child
                self._held(first, len(text) - i + NODE + TERMINAL + CLASS * len(classes))
                return child.end
            label = child.label
            if text.startswith(label, i):
                i += len(label)
                node = child
                continue
            k = _common(label, text[i: i + len(label)])
            upper = Node(label[:k])
            child.label = label[k:]
            upper.children[child.label[0]] = child
            node.children[text[i]] = upper
            self._held(first, NODE)
            node, i = upper, i + k

    def _held(self, first: int, n: int) -> None:
        if first >= 0:  # the string that ends at the root stays there
            self.bytes += n
            self.by_first[first] = self.by_first.get(first, 0) + n

    def full(self) -> bool:
        return self.bytes > self.budget

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Terminal]]:
        """(string from the skipped prefix on, terminal) of a subtree."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, before = stack.pop()
            text = before + at.label
            if at.end is not None:
                yield text, at.end
            stack.extend((c, text) for c in at.children.values())

    def spill(self, head: bytes) -> None:
        """Write the largest subtree to a file and forget it. head: the skipped prefix."""
        first = max(self.by_first, key=self.by_first.get)
        out = tempfile.TemporaryFile()
        for text, end in self.terminals(self.root.children.pop(first), head):
            pickle.dump((text, end.key, end.rows, end.classes), out, 5)
        self.spilled[first] = out
        self.bytes -= self.by_first.pop(first)


def _records(file) -> Iterator[tuple]:
    file.seek(0)
    try:
        while True:
            yield pickle.load(file)
    except EOFError:
        return


def owners(strings: Iterator[tuple[bytes, object, int, list]], budget: int = BUDGET, skip: int = 0) -> Iterator[Terminal]:
    """The terminals of all (string, key, rows, classes), each distinct string once."""
    trie = PatriciaTrie(budget, skip)
    for text, key, rows, classes in strings:
        trie.insert(text, key, rows, classes)
        if trie.full() and trie.by_first:
            trie.spill(text[:skip])
    for _, end in trie.terminals():
        yield end
    trie.root = Node(b"")
    for file in trie.spilled.values():
        shared = None
        for text, *_ in _records(file):  # go on below what all strings of the file share
            shared = text if shared is None else shared[: _common(shared, text)]
        yield from owners(_records(file), budget, max(skip + 1, len(shared or b"")) if shared else skip + 1)
        file.close()


def _order(doc_id: int | None, uid: int, largest: bool) -> tuple:
    """Smallest first: by doc_id (largest or smallest of them, null the lowest id), then as read."""
    if doc_id is None:
        return (1, 0, uid) if largest else (0, 0, uid)
    return (0, -doc_id, uid) if largest else (1, doc_id, uid)


LOCAL = ("uid long, doc_id long, class long, text_sha256 string, n_bytes long, hash long, text binary, "
         "best_id long, best_uid long, rows long")


def exact_dedup(docs: DataFrame, keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    largest = keep == "largest"

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LOCAL.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        trie, sha = PatriciaTrie(budget), {}

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for text, end in trie.terminals():
                rows.append((None, None, end.classes[0], None, len(text), xxhash.xxh64_intdigest(text) - 2**63, text,
                             end.key[3], end.key[2], end.rows))
                held += len(text)
                if held > 8 << 20 or len(rows) >= 10_000:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

        for part in parts:
            members = []
            for uid, doc_id, text in zip(part.column("uid").to_pylist(), part.column("doc_id").to_pylist(),
                                         part.column("text").cast(pa.large_binary()), strict=True):
                norm = (text.as_py() or b"").lower()  # of bytes: A-Z only
                end = trie.insert(norm, (*_order(doc_id, uid, largest), doc_id), 1, [])
                if not end.classes:
                    end.classes.append(uid)
                    sha[uid] = hashlib.sha256(norm).hexdigest()
                members.append((uid, doc_id, end.classes[0], sha[end.classes[0]], len(norm), None, None, None, None, None))
                if trie.bytes + DIGEST * len(sha) > budget:
                    yield from flush()
                    trie, sha = PatriciaTrie(budget), {}
            if members:
                yield table(members)
        yield from flush()

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    rows = written(source.mapInArrow(local, LOCAL), "exact-dedup")
    classes = rows.filter(F.col("text").isNotNull()).select("class", "n_bytes", "hash", "text", "best_id", "best_uid", "rows")

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strings() -> Iterator[tuple]:
            for part in parts:
                columns = [part.column(c).to_pylist() for c in ("class", "best_id", "best_uid", "rows")]
                for text, cls, best, uid, n in zip(part.column("text"), *columns, strict=True):
                    yield text.as_py(), (*_order(best, uid, largest), best), n, [cls]

        out: list[tuple] = []
        schema = pa.schema([("class", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])

        def table() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
            out.clear()
            return done

        for end in owners(strings(), budget):
            out.extend((c, end.key[3], end.key[2], end.rows) for c in end.classes)
            if len(out) >= 10_000:
                yield table()
        if out:
            yield table()

    owned = (classes.repartition(parallelism(docs.sparkSession), "n_bytes", "hash")
             .mapInArrow(own, "class long, keep_id long, keep_uid long, group_size long"))
    members = rows.filter(F.col("uid").isNotNull()).select("uid", "doc_id", "class", "text_sha256", "n_bytes")
    return members.join(owned, "class").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "n_bytes")

"""N-gram Jaccard join with token-combination prefixes.

Tokens are the distinct 5-word shingles of a text (words between ASCII white space, A-Z
lower-cased; fewer words: the whole sequence), as 64-bit hashes, ordered by hash. Two documents
link when ``100 * intersection >= percent * union``.

Nodes are distinct sets, so texts with equal sets meet as one node. A node of n tokens, of which
``need`` must be shared, takes its first ``n - need + k`` tokens as extended prefix: linked nodes
share at least the smaller of their k there. By how many nodes have a token in the prefix:

* rare (up to ``rare``): a single token is a signature. All pairs of the few nodes are counted,
  and a pair stays if its rare tokens and the frequent ones that both could share reach k.
* frequent: two tokens together are a signature. Only nodes with k frequent tokens or more can be
  linked by these alone. Of their whole sets the tokens that no other of these nodes has are counted:
  what is left of a set bounds what it can share, which rules most nodes, pairs and partner sizes
  out. Per size class the frequent tokens are split into k - 1 lots by hash, and pairs of tokens of
  a lot are taken from the smallest on until no n - k misses could break them all; linked nodes then
  share a combination. A combination may be in very many nodes, so a group first meets one node only,
  the one with most to share, and pairs are looked at only where that left different components.

All pairs are verified on whole sets. Groups where all nodes are already connected are never
expanded: in the result only components matter. Verification goes best pair first for each node,
then what is still apart.

Defined results: null or empty texts and texts without words have no tokens, link with nothing and
are their own component; repeated rows are members of one node; null doc_id does not count when
the smallest is sought (all null: null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import U64, blocks_by_part, byte_table, changes, dealt_blocks, flat_bytes, mix64, parallelism, shingles_of, signed, text_slices, unsigned, words_of, written
from pressroom.llm.components import components

SEED = 7
NULL_ID = -(2**63)  # stands for a null doc_id
FLUSH = 500_000  # prefix tokens that a scan task gathers before it passes them on
DOC, PAIR, FREQUENT = 0, 1, 2
BINS = 64


def need(n, percent: int):
    """Tokens of a set of n that a linked set shares at least."""
    return (percent * n + 99) // 100


def extra(n, percent: int):
    """k: tokens that linked nodes of this size share in their prefixes at least."""
    missing = n - need(n, percent)
    return np.minimum(need(n, percent), np.maximum(2, (missing + 2) // 2))


def _extra_column(n: Column, percent: int) -> Column:
    least = F.floor((F.lit(percent) * n + 99) / 100)
    return F.least(least, F.greatest(F.lit(2), F.floor((n - least + 2) / 2))).cast("long")


class SizeClasses:
    """Bounds so that sizes of linked sets are in one class or in neighbouring ones."""

    def __init__(self, percent: int, up_to: int = 1 << 40):
        self.bounds, self.percent = [1], percent
        while self.bounds[-1] < up_to:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // percent)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def least_shared(self, c: int) -> int:
        """k of the smallest node that takes part in class c."""
        return int(extra(self.bounds[max(0, c - 1)], self.percent))


def combinations(tokens: np.ndarray, n: int, classes: SizeClasses) -> np.ndarray:
    """Signatures of a node with these frequent tokens (sorted): for the class of its size and the
    next, hashes of token pairs, or of single tokens where one shared token is all there must be."""
    out = []
    for c in (classes.of(n), classes.of(n) + 1):
        k = classes.least_shared(c)
        if len(tokens) < k:
            continue
        salt = mix64(np.array([c + 1], U64))
        if k < 2:
            out.append(mix64(tokens[: len(tokens) - k + 1] ^ salt))
            continue
        lot = (mix64(tokens ^ U64(SEED)) % U64(k - 1)).astype(np.int64)
        order = np.argsort(lot, kind="stable")
        begin = np.concatenate(([True], lot[order][1:] != lot[order][:-1]))
        secured = np.ones(len(tokens), np.int64)  # a lot's first token secures nothing, each further one a pair
        secured[order[begin]] = 0
        last = int(np.searchsorted(np.cumsum(secured), len(tokens) - k + 1)) + 1
        tokens_in, lot_in = tokens[:last], lot[:last]
        order = np.argsort(lot_in, kind="stable")
        for group in np.split(tokens_in[order], np.flatnonzero(np.diff(lot_in[order])) + 1):
            if len(group) > 1:
                a, b = np.triu_indices(len(group), 1)
                out.append(mix64(group[a] * U64(0x9E3779B97F4A7C15) + mix64(group[b]) ^ salt))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.xxhash64("doc_id", "text").alias("uid"), "text")


def _prefixes(docs: DataFrame, percent: int, rare: int, parts_n: int) -> DataFrame:
    """Rows of kind DOC (a: node, b: doc, w: uid, na: tokens), PAIR (a, b: nodes, w: shared rare
    tokens, na, nb: sizes) and FREQUENT (a: token, b: node, nb: size)."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SEED)

        def flush(rows: list[tuple], sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            doc, uid, node, size = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            nodes = np.fromiter(sets, np.int64, len(sets))
            sizes = np.array([n for n, _ in sets.values()], np.int64)
            prefix = [p for _, p in sets.values()]
            owner = np.repeat(np.arange(len(nodes)), [len(p) for p in prefix])
            token = np.concatenate(prefix) if prefix else np.zeros(0, U64)
            part = (mix64(token) % U64(parts_n)).astype(np.int64)
            order = np.lexsort((token, part))
            token, owner, part = token[order], owner[order], part[order]
            new = changes(token)
            group = np.cumsum(new) - 1
            # what is frequent within the task already goes on spread out, and is named once
            many = np.bincount(group, minlength=1)[group] > rare
            named, named_part = token[new & many], part[new & many]
            through = (token[many], nodes[owner[many]], sizes[owner[many]])
            token, owner, part = token[~many], owner[~many], part[~many]
            at, named_at = np.searchsorted(part, np.arange(parts_n + 1)), np.searchsorted(named_part, np.arange(parts_n + 1))
            share = np.linspace(0, len(doc), parts_n + 1).astype(int)
            spread = np.linspace(0, len(through[0]), parts_n + 1).astype(int)
            for p in range(parts_n):
                here, places = np.unique(owner[at[p]: at[p + 1]], return_inverse=True)
                s, t = slice(share[p], share[p + 1]), slice(spread[p], spread[p + 1])
                names = named[named_at[p]: named_at[p + 1]]
                if len(here) or len(names) or s.stop > s.start or t.stop > t.start:
                    block = pickle.dumps((token[at[p]: at[p + 1]], places.astype(np.int32), nodes[here], sizes[here].astype(np.int32), names,
                                          (node[s], doc[s], uid[s], size[s]), tuple(x[t] for x in through)), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

        rows, sets, held = [], {}, 0
        for whole in parts:
            for batch in text_slices(whole, "text"):
                data, off = flat_bytes(batch.column("text"))
                found = shingles_of(*words_of(data, off, table))
                for doc, uid, tokens in zip(batch.column("doc").to_pylist(), batch.column("uid").to_pylist(), found, strict=True):
                    n = len(tokens)
                    node = int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if n else 0
                    rows.append((doc, uid, node, n))
                    if n and node not in sets:
                        prefix = tokens[: n - need(n, percent) + int(extra(n, percent))].copy()
                        sets[node] = (n, prefix)
                        held += len(prefix)
                if held >= FLUSH:
                    yield from flush(rows, sets)
                    rows, sets, held = [], {}, 0
        if rows:
            yield from flush(rows, sets)

    names = ["kind", "a", "b", "w", "na", "nb"]

    def out(kind: int, a, b, w, na, nb) -> pa.RecordBatch:
        columns = [np.broadcast_to(np.asarray(x, np.int64), len(a)) for x in (a, b, w, na, nb)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            loaded = [pickle.loads(b) for b in blocks]
            node, doc, uid, size = (np.concatenate([x[5][i] for x in loaded]) for i in range(4))
            yield out(DOC, node, doc, uid, size, 0)
            token, owner, sizes = (np.concatenate([x[6][i] for x in loaded]) for i in range(3))
            yield out(FREQUENT, signed(token), owner, 0, 0, sizes)
            token = np.concatenate([x[0] for x in loaded])
            owner = np.concatenate([x[2][x[1]] for x in loaded])
            sizes = np.concatenate([x[3][x[1]] for x in loaded]).astype(np.int64)
            order = np.lexsort((owner, token))
            token, owner, sizes = token[order], owner[order], sizes[order]
            if not len(token):
                return
            once = changes(token, owner)
            token, owner, sizes = token[once], owner[once], sizes[once]
            new = changes(token)
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            many = (count > rare) | np.isin(token[new], np.concatenate([x[4] for x in loaded]))
            rows = many[group]
            yield out(FREQUENT, signed(token[rows]), owner[rows], 0, 0, sizes[rows])
            rows = (~many & (count > 1))[group]
            owner, sizes, first = owner[rows], sizes[rows], np.flatnonzero(new[rows])
            if not len(first):
                return
            length = np.diff(np.append(first, len(owner)))
            # tokens with the same nodes count together
            kind = mix64(np.add.reduceat(mix64(unsigned(owner)), first) + length.astype(U64))
            _, at, times = np.unique(kind, return_index=True, return_counts=True)
            found = []
            for d in np.unique(length[at]).tolist():
                these = at[length[at] == d]
                grid = first[these][:, None] + np.arange(d)
                x, y = np.triu_indices(d, 1)
                a, b = grid[:, x].ravel(), grid[:, y].ravel()
                w = np.repeat(times[length[at] == d], len(x))
                fit = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
                found.append((owner[a][fit], owner[b][fit], w[fit], sizes[a][fit], sizes[b][fit]))
            a, b, w, na, nb = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((b, a))
            a, b, w, na, nb = a[order], b[order], w[order], na[order], nb[order]
            if len(a):
                first = np.flatnonzero(changes(a, b))
                yield out(PAIR, a[first], b[first], np.add.reduceat(w, first), na[first], nb[first])

        for blocks in blocks_by_part(parts):
            yield from done(blocks)

    blocks = dealt_blocks(_identified(docs).mapInArrow(cut, "part int, block binary"), parts_n)
    return written(blocks.mapInArrow(meet, "kind int, a long, b long, w long, na long, nb long"), "join-prefixes")


def _heavy(frequent: DataFrame, percent: int) -> DataFrame:
    """(node, n, tokens) of the nodes that have enough frequent tokens to be linked by these alone."""
    nodes = frequent.select(F.col("b").alias("node"), F.col("nb").alias("n"), F.col("a").alias("token")).distinct()
    nodes = nodes.groupBy("node", "n").agg(F.collect_list("token").alias("tokens"))  # of one node: at most its set
    smallest = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    return written(nodes.filter(F.size("tokens") >= _extra_column(smallest, percent)), "join-heavy")


def _bounds(texts: DataFrame, parts_n: int) -> DataFrame:
    """(node, free, bins) of each text (node, text): free is how many of its tokens other texts have
    too, bins counts these by BINS classes of hash (a byte each, 255: that many or more). What two
    nodes share is at most the smaller free, and at most the sum of the smaller bins."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SEED)
        for whole in parts:
            for batch in text_slices(whole, "text"):
                sets = shingles_of(*words_of(*flat_bytes(batch.column("text")), table))
                nodes = batch.column("node").to_numpy()
                token = np.concatenate(sets)
                owner = np.repeat(np.arange(len(nodes)), [len(s) for s in sets])
                part = (mix64(token) % U64(parts_n)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(parts_n + 1))
                token, owner = token[order], owner[order]
                for p in np.flatnonzero(np.diff(at)):
                    here, places = np.unique(owner[at[p]: at[p + 1]], return_inverse=True)
                    block = pickle.dumps((token[at[p]: at[p + 1]], places.astype(np.int32), nodes[here]), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

    def alone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens that one node only has, as blocks of nodes and classes dealt by node."""
        for blocks in blocks_by_part(parts):
            loaded = [pickle.loads(b) for b in blocks]
            token = np.concatenate([t for t, _, _ in loaded])
            owner = np.concatenate([nodes[places] for _, places, nodes in loaded])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            new = changes(token)
            only = new & np.append(new[1:], True)
            classes, owner = (token[only] % U64(BINS)).astype(np.uint8), owner[only]
            to = (mix64(unsigned(owner)) % U64(parts_n)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            classes, owner = classes[order], owner[order]
            at = np.searchsorted(to[order], np.arange(parts_n + 1))
            for p in np.flatnonzero(np.diff(at)):
                block = pickle.dumps((owner[at[p]: at[p + 1]], classes[at[p]: at[p + 1]]), 5)
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in blocks_by_part(parts):
            owner, classes = (np.concatenate(x) for x in zip(*map(pickle.loads, blocks), strict=True))
            order = np.argsort(owner, kind="stable")
            owner, classes = owner[order], classes[order]
            first = np.flatnonzero(changes(owner))
            lists = [c.tobytes() for c in np.split(classes, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(lists, pa.binary())], names=["node", "own"])

    def subtract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SEED)
        for whole in parts:
            for batch in text_slices(whole, "text"):
                rows = []
                sets = shingles_of(*words_of(*flat_bytes(batch.column("text")), table))
                for node, own, tokens in zip(batch.column("node").to_pylist(), batch.column("own").to_pylist(), sets, strict=True):
                    bins = np.bincount((tokens % U64(BINS)).astype(np.int64), minlength=BINS)
                    bins -= np.bincount(np.frombuffer(own or b"", np.uint8), minlength=BINS)
                    rows.append((node, int(bins.sum()), np.minimum(bins, 255).astype(np.uint8).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                                 names=["node", "free", "bins"])

    texts = texts.select("node", "text")
    blocks = dealt_blocks(texts.mapInArrow(cut, "part int, block binary"), parts_n).mapInArrow(alone, "part int, block binary")
    own = dealt_blocks(blocks, parts_n).mapInArrow(gather, "node long, own binary")
    return texts.join(own, "node", "left").mapInArrow(subtract, "node long, free long, bins binary")


def _could_link(n: Column, free: Column, m: Column, other_free: Column, percent: int) -> Column:
    """Whether sets of n and m tokens of which so many may be shared can reach the threshold."""
    shared = F.least(free, other_free)
    return shared * 100 >= (n + m - shared) * percent


def _signatures(heavy: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, free) of heavy nodes (node, n, tokens, free). Rows without a possible partner
    size under their key are left out."""
    classes = SizeClasses(percent)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for node, n, free, tokens in zip(*(part.column(c).to_pylist() for c in ("node", "n", "free")), part.column("tokens"), strict=True):
                keys = combinations(np.sort(unsigned(tokens.values.to_numpy())), n, classes)
                if len(keys):
                    columns = [np.full(len(keys), x, np.int64) for x in (node, n, free)]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), *map(pa.array, columns)], names=["key", "node", "n", "free"])

    rows = written(heavy.select("node", "n", "free", "tokens").filter(_could_link(F.col("n"), F.col("free"), F.col("free"), F.col("free"), percent))
                   .mapInArrow(batches, "key long, node long, n long, free long"), "join-signatures")
    # per key the sizes there are, each with the most that one of this size has free: as many as sizes in a class
    sizes = rows.groupBy("key", "n").agg(F.max("free").alias("most"), F.count("*").alias("rows"))
    sizes = sizes.groupBy("key").agg(F.collect_list(F.struct("n", "most", "rows")).alias("sizes"), F.sum("rows").alias("total")).filter("total > 1").drop("total")
    n, own_free = F.col("n"), F.col("free")
    possible = F.exists("sizes", lambda s: ((s["n"] != n) | (s["rows"] > 1)) & _could_link(n, own_free, s["n"], s["most"], percent))
    return rows.join(sizes, "key").filter(possible).drop("sizes")


class _Texts:
    """The texts of nodes, fetched from the table when pairs first need them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int):
        self.docs, self.nodes, self.percent, self.have = _identified(docs), nodes, percent, None

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of at least the wanted nodes."""
        if self.have is not None:
            wanted = wanted.join(self.have.select("node"), "node", "left_anti")
        keys = wanted.join(self.nodes, "node").select("node", F.col("first.doc").alias("doc"), F.col("first.uid").alias("uid"))
        more = written(self.docs.join(keys, ["doc", "uid"]).select("node", "text").dropDuplicates(["node"]), "join-texts")
        self.have = more if self.have is None else self.have.unionAll(more)
        return self.have

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        percent = self.percent
        pairs = written(pairs.select("a", "b").distinct(), "join-pairs")
        if pairs.isEmpty():
            return pairs
        texts = self.fetch(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())

        def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = byte_table(SEED)
            for whole in parts:
                for batch in text_slices(whole, "text_b", 1 << 20):
                    sets = []
                    for c in "ab":
                        node = batch.column(c).to_numpy()
                        _, first, back = np.unique(node, return_index=True, return_inverse=True)
                        found = shingles_of(*words_of(*flat_bytes(batch.column(f"text_{c}").take(pa.array(first))), table))
                        sets.append([found[i] for i in back])
                    good = []
                    for x, y in zip(*sets, strict=True):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int((y[at] == x).sum())
                        good.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield batch.select(["a", "b"]).filter(pa.array(good))

        a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return written(joined.mapInArrow(verify, "a long, b long"), "join-links")


def _clusters_apart(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the nodes of a cluster that are in different components and could link by
    their sizes, their free tokens and the bins of these. rows: cluster, node, component, n, free,
    bins. Nodes outside a cluster's largest component are compared with all, in blocks."""
    def compare(node, component, n, free, bins) -> Iterator[pa.RecordBatch]:
        names, code, count = np.unique(component, return_inverse=True, return_counts=True)
        outside = np.flatnonzero(code != count.argmax())
        step = max(1, 32_000_000 // (BINS * len(node)))
        for at in range(0, len(outside), step):
            x = outside[at: at + step]
            shared = np.minimum(free[x][:, None], free[None, :])
            fit = (code[x][:, None] != code[None, :]) & (100 * shared >= percent * (n[x][:, None] + n[None, :] - shared))
            i, j = np.nonzero(fit)
            i = x[i]
            for part in range(0, len(i), 500_000):
                a, b = i[part: part + 500_000], j[part: part + 500_000]
                both = np.minimum(bins[a], bins[b]).astype(np.int64)
                shared = np.where((both == 255).any(1), np.minimum(free[a], free[b]), both.sum(1))
                good = 100 * shared >= percent * (n[a] + n[b] - shared)
                pairs = np.unique(np.column_stack((np.minimum(node[a], node[b])[good], np.maximum(node[a], node[b])[good])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def clusters(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            *numbers, bins = zip(*held, strict=True)
            return compare(*(np.array(x, np.int64) for x in numbers), np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS))

        for batch in parts:
            for cluster, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "node", "component", "n", "free", "bins")), strict=True):
                if cluster != now and held:
                    yield from done()
                    held = []
                now = cluster
                held.append(row)
        if held:
            yield from done()

    dealt = rows.repartition(parallelism(rows.sparkSession), "cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(clusters, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"component_{c}")) for c in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def _grouped(docs: DataFrame, percent: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """(node, doc, uid, n) of every row, and (node, component, smallest, first) of every node: the
    smallest doc_id and the first row of its own."""
    if not 50 <= percent <= 100 or rare < 2:
        raise ValueError("percent from 50 to 100, rare from 2")
    rows = _prefixes(docs, percent, rare, parallelism(docs.sparkSession))
    members = rows.filter(F.col("kind") == DOC).select(F.col("a").alias("node"), F.col("b").alias("doc"), F.col("w").alias("uid"), F.col("na").alias("n"))
    nodes = members.filter("n > 0").groupBy("node").agg(F.min(F.struct((F.col("doc") == NULL_ID).alias("none"), "doc", "uid")).alias("first"),
                                                       F.min(F.when(F.col("doc") != NULL_ID, F.col("doc"))).alias("smallest"))
    nodes = written(nodes, "join-nodes")
    texts = _Texts(docs, nodes, percent)
    frequent = rows.filter(F.col("kind") == FREQUENT)
    held = written(frequent.groupBy(F.col("b").alias("node")).agg(F.count_distinct("a").alias("h")), "join-frequent")

    pairs = rows.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    ha, hb = (held.select(F.col("node").alias(c), F.col("h").alias(f"h{c}")) for c in "ab")
    pairs = pairs.join(ha, "a", "left").join(hb, "b", "left")
    both = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = written(pairs.filter(F.col("w") + both >= F.least(_extra_column(F.col("na"), percent), _extra_column(F.col("nb"), percent))).select("a", "b", "w"), "join-candidates")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a"))

    heavy = _heavy(frequent, percent)
    heavy = written(heavy.join(_bounds(texts.fetch(heavy.select("node")), parallelism(docs.sparkSession)), "node"), "join-bounds")
    keys = written(_signatures(heavy, percent), "join-signatures")
    pivots = keys.groupBy("key").agg(F.max(F.struct("free", (-F.col("node")).alias("order"), "node", "n")).alias("p"))
    stars = keys.join(pivots, "key").filter((F.col("node") != F.col("p.node")) & _could_link(F.col("n"), F.col("free"), F.col("p.n"), F.col("p.free"), percent))
    stars = written(stars.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("w")), "join-stars")
    best_star = stars.groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a"))

    links = texts.linked(best.select("a", "b").unionAll(best_star.select("a", "b")))
    labels = components(links)
    more = texts.linked(_apart(pairs.select("a", "b").unionAll(stars.select("a", "b")), labels))
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = components(links)

    # what shares a combination and is still apart: the groups of keys whose pivots are connected are
    # taken as one, each node once
    component = F.coalesce("component", "node").alias("component")
    rows = keys.select("key", "node").join(labels, "node", "left").select("key", "node", component)
    mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    of_pivot = pivots.join(mixed, "key").select("key", F.col("p.node").alias("node")).join(labels, "node", "left").select("key", component)
    rows = rows.join(of_pivot.withColumnRenamed("component", "cluster"), "key").select("cluster", "node", "component").distinct()
    rows = written(rows.join(heavy.select("node", "n", "free", "bins"), "node"), "join-apart")
    more = texts.linked(_clusters_apart(rows, percent).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    return members, nodes.join(labels, "node", "left").select("node", "smallest", "first", F.coalesce("component", "node").alias("component"))


def link_components(docs: DataFrame, percent: int = 75, rare: int = 32) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node (of its set; null without)."""
    members, named = _grouped(docs, percent, rare)
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id")
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id")
    linked = members.filter("n > 0").join(of_node, "node").select(doc_id, F.col("n").alias("n_shingles"), "component_id", "node")
    alone = members.filter("n = 0").select(doc_id, F.col("n").alias("n_shingles"), doc_id.alias("component_id"), F.lit(None).cast("long").alias("node"))
    return linked.unionAll(alone)


def keep_one(docs: DataFrame, percent: int = 75, rare: int = 32) -> DataFrame:
    """Of every component one row, that of the smallest doc_id (null last; of several the first by
    a hash of the content), with all its columns. Rows without tokens all stay."""
    members, named = _grouped(docs, percent, rare)
    one = named.groupBy("component").agg(F.min("first").alias("one")).select(F.col("one.doc").alias("doc"), F.col("one.uid").alias("uid"), F.lit(True).alias("tokens"))
    empty = members.filter("n = 0").select("doc", "uid", F.lit(False).alias("tokens")).distinct()
    stays = written(one.unionAll(empty), "join-kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("uid"),
                         F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row"))
    kept = packed.join(stays, ["doc", "uid"]).withColumn("tie", F.when(F.col("tokens"), F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc", "uid", "tie"]).select(*[F.col("row")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)])

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressroom.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """{conv_id: [(role, text)]} with shared openings, by plain lists."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h[c]] + t[h[c]:] for c, t in own.items()}


def plain_nodes(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    out, totals = [], {}
    for n in sorted(members, key=len, reverse=True):
        kids = children[n]
        own = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        totals[n] = (sum(totals[k][0] for k in kids) if kids else 1, own + sum(totals[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c in members[n] if len(convs[c]) == len(n))))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids), *totals[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=400))
def test_findclose_of_any_sequence(bits):
    depth, opens = 0, []
    for b in bits:  # made balanced
        if b or depth == 0:
            opens.append(1)
            depth += 1
        else:
            opens.append(0)
            depth -= 1
    opens = np.array(opens + [0] * depth, bool)
    stack, want = [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        else:
            want[stack.pop()] = i
    at = np.flatnonzero(opens)
    assert pt.Excess(opens).findclose(at).tolist() == [want[i] for i in at.tolist()]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 5000])
def test_deep_chains(n):
    opens = np.array([1] * n + [0] * n, bool)
    assert pt.Excess(opens).findclose(np.arange(n)).tolist() == [2 * n - 1 - i for i in range(n)]


def test_range_minimum():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, 300)
    begin = rng.integers(0, 299, 500)
    end = np.array([rng.integers(b + 1, 301) for b in begin])
    assert pt.range_minimum(x, begin, end).tolist() == [int(x[b:e].min()) for b, e in zip(begin, end, strict=True)]


def conversations(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        common = rng.random() < 0.4
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["hi", "hi", "", None, "été 한"]) if common else f"{rng.randint(0, 3)}"
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    rows += [(5 * n, i, "user", "x" * (i % 3)) for i in range(long)]
    return rows


@pytest.mark.parametrize("shard_nodes", [0, 3, 40, 4096])
def test_against_plain_nodes(spark, shard_nodes):
    rows = conversations(shard_nodes, 150, long=300)
    rows += [(1000 + i, t, "user", "same") for i in range(60) for t in range(10)]  # copies
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert rows_of(pt.conversation_trie(turns, shard_nodes)) == plain_nodes(rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (None, 0, "user", "lost"), (2, 5, "", ""),
            (3, 0, "us", "er"), (4, 0, "user", ""), (4, 0, "u", "ser"), (-3, 0, "user", "below zero"), (-5, 1, "user", "z"), (10, 0, "user", "long " * 400_000),
            (11, 0, "user", "long " * 400_000), (2**62, 0, "user", "far")]
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "2 AS key", "'x' AS above").repartition(3)
    assert rows_of(pt.conversation_trie(turns)) == plain_nodes(rows)
    assert pt.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    # conversations whose opening comes from one that does not exist, and nothing of their own behind it
    short = [c for c in range(200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    rows = [(c, 0, "user", "x") for c in short]
    got = rows_of(pt.conversation_trie(spark.createDataFrame(rows, TURNS)))
    assert got == plain_nodes(rows) and len(got) == 1 and got[0][5] == 1


def test_digests_of_many_ends(spark):
    ids = list(range(-50, 3000))
    rows = [(b"a" * 16, i) for i in ids] + [(b"b" * 16, 7)]
    ends = spark.createDataFrame(rows, "key binary, conv_id long").repartition(6)
    got = {bytes(r["key"]): r["ends_sha256"] for r in pt.end_digests(ends, piece_bytes=100).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert got == {b"a" * 16: sha(ids), b"b" * 16: sha([7])}

import hashlib
import random
import tracemalloc

import pytest

from pressroom.llm.exact_dedup import PatriciaTrie, exact_dedup, owners
from tests.llm.plain import AWKWARD, DOCS


@pytest.mark.parametrize("budget", [1 << 20, 200, 1])
def test_trie_owners_with_and_without_spill(budget):
    rng = random.Random(budget)
    texts = [("ab" * rng.randint(0, 20) + rng.choice(["", "a", "b", "abc", "\0"]) * rng.randint(0, 4)).encode() for _ in range(400)]
    want = {}
    for i, t in enumerate(texts):
        key, rows, classes = want.get(t, (i, 0, []))
        want[t] = (min(key, i), rows + 1, [*classes, i])
    got = [(e.key, e.rows, sorted(e.classes)) for e in owners(((t, i, 1, [i]) for i, t in enumerate(texts)), budget)]
    assert sorted(got) == sorted(want.values())


def test_budget_counts_what_short_texts_take(monkeypatch):
    """Short texts are mostly nodes: the trie spills by what Python holds, not by the bytes of the labels."""
    spilled, peak, spill, budget = [], [0], PatriciaTrie.spill, 8 << 20

    def watched(trie, head):
        peak[0] = max(peak[0], tracemalloc.get_traced_memory()[0])
        spilled.append(trie.bytes)
        spill(trie, head)

    monkeypatch.setattr(PatriciaTrie, "spill", watched)
    strings = (f"{i * 7919 % 100_000:012d}"[::-1].encode() for i in range(200_000))
    tracemalloc.start()
    found = sum(e.rows == 2 for e in owners(((t, i, 1, [i]) for i, t in enumerate(strings)), budget))
    tracemalloc.stop()
    assert found == 100_000 and spilled and peak[0] < 1.5 * budget


def test_very_long_texts_are_whole_strings(spark):
    """Texts of several megabytes, alone beyond the budget, that differ in the last byte only."""
    long = "word " * 600_000
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "A"), (4, "short"), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for budget in (64 << 20, 1 << 20):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["n_bytes"]) for r in exact_dedup(docs, "largest", budget).collect()}
        assert got == {1: (3, 2, 3_000_001), 2: (2, 1, 3_000_001), 3: (3, 2, 3_000_001), 4: (4, 1, 5), 5: (5, 1, 3_000_000)}


def test_terminals_return_what_was_inserted():
    trie = PatriciaTrie()
    texts = [b"", b"a", b"abc", b"abd", b"ab", b"xyz"]
    for i, t in enumerate(texts):
        trie.insert(t, i, 1, [i])
    assert sorted(t for t, _ in trie.terminals()) == sorted(texts)


@pytest.mark.parametrize("keep,budget", [("largest", 64 << 20), ("smallest", 64 << 20), ("largest", 100)])
def test_documents(spark, keep, budget):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "keep_id").repartition(3)
    got = exact_dedup(docs, keep, budget).collect()
    assert len(got) == len(AWKWARD)
    norm = lambda t: (t or "").encode().lower()
    groups = {}
    for d, t, *_ in AWKWARD:
        groups.setdefault(norm(t), []).append(d)
    for r in got:
        group = next(g for t, g in groups.items() if hashlib.sha256(t).hexdigest() == r["text_sha256"])
        ids = [d for d in group if d is not None]
        assert r["group_size"] == len(group)
        assert r["keep_id"] == ((max if keep == "largest" else min)(ids) if ids else None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0

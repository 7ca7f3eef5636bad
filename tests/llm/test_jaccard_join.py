import random

import numpy as np
import pytest

from pressroom.llm import jaccard_join as j
from pressroom.llm.components import components
from pressroom.llm.queries import QUERIES
from tests.conftest import SF01
from tests.llm.plain import AWKWARD, DOCS, join_components


def corpus(seed):
    """Near copies in groups of many sizes, passages that texts share, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(8)]
    rows = []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base = base[:rng.randint(0, 20)] + rng.choice(passages) + rng.choice(passages) + base[20:40]
        for _ in range(rng.choice([1, 2, 5, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if text:
                    i = rng.randrange(len(text))
                    text[i:i + rng.choice([0, 1])] = [rng.choice(words)]
            rows.append((len(rows), " ".join(text)))
    return rows + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "A b"), (1004, "a B"), (1005, "a b c d e f g h")]


@pytest.mark.parametrize("rare,seed", [(2, 1), (4, 2), (32, 3)])
def test_components_against_all_pairs(spark, rare, seed):
    rows = corpus(seed)
    got = j.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rare=rare).collect()
    assert sorted(tuple(r)[:3] for r in got) == join_components(rows)


def test_linked_sets_share_a_combination():
    """Frequent tokens alone: every pair that could link meets in a signature."""
    rng = np.random.default_rng(5)
    classes = j.SizeClasses(75)
    for _ in range(300):
        n = int(rng.integers(2, 150))
        m = int(rng.integers(-(-75 * n // 100), 100 * n // 75 + 1))
        k = int(min(j.extra(n, 75), j.extra(m, 75)))
        own = [int(rng.integers(k, max(k + 1, x - j.need(x, 75) + j.extra(x, 75) + 1))) for x in (n, m)]
        shared = rng.integers(1, 2**63, k).astype(np.uint64)
        sets = [np.unique(np.concatenate((shared, rng.integers(1, 2**63, o - k).astype(np.uint64)))) for o in own]
        keys = [j.combinations(s, x, classes) for s, x in zip(sets, (n, m), strict=True)]
        assert len(np.intersect1d(*keys))


def test_components_of_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "node").withColumnRenamed("source", "uid").repartition(3)
    got = sorted((tuple(r)[:3] for r in j.link_components(docs).collect()), key=str)
    assert len(got) == len(AWKWARD)
    assert [x for x in got if x[0] in (1, 5)] == [(1, 4, 1), (5, 4, 1), (5, 4, 1)]
    assert [x for x in got if x[0] in (2, 3, 4)] == [(2, 0, 2), (3, 0, 3), (4, 0, 4)]
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "None"])
    assert j.link_components(docs.limit(0)).count() == 0 and j.keep_one(docs.limit(0)).count() == 0


def test_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op7_jaccard_join"](spark, SF01).collect()) == join_components(rows)

import numpy as np
import pytest

from pressroom.llm import learned_index as li
from pressroom.llm.queries import QUERIES
from tests.conftest import SF01

VECS = "vec_id long, embedding array<float>, label int"


def read(path):
    import pyarrow.parquet as pq
    t = pq.read_table(path)
    return t["vec_id"].to_numpy(), li.matrix(t["embedding"])


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


def clustered(n, dim, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    return np.float32(centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)))


def test_balanced_parts_cut_fewer_edges():
    x = clustered(1500, 16, 12, 1).astype(np.float64)
    graph = li.neighbour_graph(x, 10)
    part = li.balanced_partition(x, graph, 12)
    sizes = np.bincount(part, minlength=12)
    assert sizes.max() <= np.ceil(1500 / 12 * 1.05) and sizes.min() >= np.floor(1500 / 12 * 0.95) - 1
    cut = lambda p: (p[graph] != p[:, None]).mean()
    start = li.balanced_partition(x, graph, 12, rounds=0)
    assert cut(part) < cut(start) < cut(np.random.default_rng(0).permutation(part))


def test_router_sends_rows_of_clusters_to_few_parts():
    x = clustered(2000, 16, 16, 2).astype(np.float64)
    router, probes = li.fit(x, 16, 10, 0.95)
    assert len(router.weights[3]) == 16 and probes <= 5
    assert li.fit(np.random.default_rng(3).normal(size=(2000, 64)), 16, 10, 0.95)[1] > probes


@pytest.mark.parametrize("block_rows,block_queries", [(512, 512), (60, 3)])
def test_recall_and_blocks(spark, block_rows, block_queries):
    x = clustered(4000, 24, 30, 4)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECS).repartition(4)
    got = found(li.nearest(rows, every=25, part_rows=200, sample=2000, block_rows=block_rows, block_queries=block_queries))
    want = li.exact_nearest(np.arange(4000), x.astype(np.float64), 10, 25)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, hits in got.items():  # the right score, nearest first, ties to the smaller id
        assert len(hits) == 10 and hits == sorted(hits, key=lambda h: (h[1], h[0])) and q not in dict(hits)
        for i, score in hits:
            assert score == pytest.approx(float(np.sqrt(((x[i].astype(np.float64) - x[q]) ** 2).sum())), rel=1e-12, abs=1e-12)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 0.0], None), (9, [0.0, 2.0], None),
            (200, [nan, 0.0], 1), (300, None, 1)]
    df = spark.createDataFrame(rows, VECS).selectExpr("*", "1 AS part", "2 AS rank", "3 AS score").repartition(3)
    got = found(li.nearest(df))
    far = np.sqrt(5.0)
    assert got == {0: [(8, 0.0), (100, 0.0), (9, pytest.approx(far))], 100: [(0, 0.0), (8, 0.0), (9, pytest.approx(far))]}
    assert li.nearest(spark.createDataFrame([], VECS)).count() == 0
    assert li.nearest(spark.createDataFrame([(0, [1.0], 1)], VECS)).count() == 0


def test_one_vector_copied_often(spark):
    """A part of copies is dealt out, and ties go to the smallest ids."""
    x = clustered(600, 8, 6, 5)
    rows = [(i, x[0 if i % 2 else i].tolist(), 0) for i in range(600)]
    got = found(li.nearest(spark.createDataFrame(rows, VECS), every=50, part_rows=50, block_rows=20))
    values = np.array([r[1] for r in rows])
    want = li.exact_nearest(np.arange(600), values, 10, 50)
    assert got[0] == [(i, 0.0) for i in range(1, 21, 2)] and recall(got, want) >= 0.9


def test_few_rows_in_the_probed_parts(spark):
    """However few rows the most probable parts hold, k neighbours are returned if there are any."""
    x = clustered(60, 4, 20, 6)
    got = found(li.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECS), k=30, every=10, recall=0.01, part_rows=3))
    assert all(len(hits) == 30 for hits in got.values()) and len(got) == 6


def test_query_recall_over_whole_table(spark):
    ids, x = read(f"{SF01}/embeddings.parquet")
    got = found(QUERIES["op11_learned_index"](spark, SF01))
    want = li.exact_nearest(ids, x, 10, 100)
    assert got.keys() == want.keys() and all(len(h) == 10 for h in got.values()) and recall(got, want) >= 0.9

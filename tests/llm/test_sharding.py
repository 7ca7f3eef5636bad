import zlib

import numpy as np
import pytest

from pressroom.llm import sharding
from pressroom.llm.queries import QUERIES
from tests.conftest import SF01
from tests.llm.plain import AWKWARD, DOCS


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    at = sharding.permute(rows, n, seed=5)
    assert sorted(at.tolist()) == rows.tolist()
    assert (sharding.permute(at, n, seed=5, back=True) == rows).all()
    if n > 100:
        assert (at != sharding.permute(rows, n, seed=6)).any() and abs(np.corrcoef(rows, at)[0, 1]) < 0.15
    shard, slot = sharding.place_of(n - 1, n, 7, seed=5)
    assert sharding.row_at(shard, slot, n, 7, seed=5) == n - 1


def check(rows, got, shards):
    text = lambda t: (t or "").encode()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len(text(t)) + 8, zlib.crc32(text(t))) for d, t in rows)
    assert {r["row_number"] for r in got} == set(range(len(rows)))
    slots = {}
    for r in got:
        assert (r["shard"], r["slot"]) == sharding.place_of(r["row_number"], len(rows), shards, 9)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "shard").repartition(4)
    check([r[:2] for r in AWKWARD], sharding.shard(docs, 3, seed=9).collect(), 3)
    assert sharding.shard(spark.createDataFrame([], DOCS), 3).count() == 0


def test_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    first = QUERIES["op9_feistel_sharding"](spark, SF01).collect()
    check(rows, first, 24)
    again = QUERIES["op9_feistel_sharding"](spark, SF01)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again.collect()), key=str)
    by_id = sorted(first, key=lambda r: r["doc_id"])
    assert [r["row_number"] for r in by_id] == list(range(len(rows)))

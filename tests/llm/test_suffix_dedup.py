import hashlib
import random

import numpy as np
import pytest

from pressroom.llm import suffix_dedup as s
from pressroom.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.plain import AWKWARD, DOCS, without_repeats


def test_transform_and_common_prefixes(tmp_path):
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 25))) for _ in range(40)] + [b"abab", b"abab", b"b"]
    collection = s.Collection(strings, str(tmp_path))
    bwt, lcp = collection.build()
    suffixes = sorted((t[k:], i, k) for i, t in enumerate(strings) for k in range(len(t) + 1))
    suffixes.sort(key=lambda x: (x[0] + b"", x[1]))
    # a suffix that ends orders before what goes on, and ends order by string
    assert bwt.tolist() == [strings[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
    want = [0]
    for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        want.append(n)
    assert lcp.tolist() == want
    for size, active, row in collection.rows(bwt, 1):
        assert all(suffixes[r][1:] == (i, len(strings[i]) - size) for i, r in zip(active.tolist(), row.tolist(), strict=True))


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 7, 61, 64):
        assert s.sliding_min(x, width).tolist() == [int(x[i:i + width].min()) for i in range(200 - width + 1)]


@pytest.mark.parametrize("length,anchor,hot", [(30, 12, 20_000), (100, 40, 20_000), (30, 12, 3)])
def test_against_all_windows(spark, length, anchor, hot):
    rng = random.Random(length + hot)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 200))) for _ in range(12)]
    rows = []
    for i in range(50):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 8)))
        rows.append((i, rng.choice([text] * 8 + ["a" * rng.randint(0, 900), "abc" * rng.randint(0, 300)])))
    rows += [(100, None), (101, ""), (None, parts[0] * 2), (102, rows[3][1]), (103, rows[3][1][:250] + "x" + rows[3][1][250:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = s.remove_repeats(docs, length=length, anchor=anchor, hot=hot, collection_bytes=4000).collect()
    assert sorted(((*tuple(r)[:4], bytes(r[4])) for r in got), key=str) == sorted(without_repeats(rows, length), key=str)


def test_hot_windows_meet_in_no_collection(spark, monkeypatch):
    """Copies of a hot window are taken together before the suffix order, whatever their number."""
    rng = random.Random(17)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40))
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(15, 60)))
    rows = [(i, text() + passage + text()) for i in range(400)]
    # a collection is closed at collection_bytes, after at most the fragments of one fingerprint more
    length, hot, room, repeats = 30, 20, 2000, s.repeats
    bound = room + hot * (length + s.RUN - 1)

    def bounded(strings, *more):
        if sum(map(len, strings)) > bound:
            raise ValueError("copies of hot windows in one collection")
        return repeats(strings, *more)

    monkeypatch.setattr(s, "repeats", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = s.remove_repeats(docs, length=length, anchor=12, hot=hot, collection_bytes=room).collect()
    assert sorted((*tuple(r)[:4], bytes(r[4])) for r in got) == sorted(without_repeats(rows, length))


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "kept").withColumnRenamed("source", "uid").repartition(3)
    got = s.remove_repeats(docs).collect()
    want = {r[0]: r[1:] for r in without_repeats([r[:2] for r in AWKWARD], 100)}
    assert len(got) == len(AWKWARD) and all((*tuple(r)[1:4], bytes(r[4])) == want[r["doc_id"]] for r in got)
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op10_suffix_dedup"](spark, SF001).collect())
    assert got == sorted((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in without_repeats(rows, 100))

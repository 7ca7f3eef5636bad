"""The keyed stream: restarts, late and repeated keys, null keys and orders, counts per batch, expiry."""

import datetime as dt
import random

from pressroom.streaming import ingest, keyed

SCHEMA = "k string, f long, v string"
BATCHES = [[("a", 5, "x"), ("a", 5, "y"), ("a", 6, "n"), (None, 1, "z")], [("a", 1, "late"), ("a", 5, "more"), ("b", 2, "b"), ("b", None, "n")],
           [(None, 1, "z2"), ("c", None, "c"), ("b", 2, "bb"), ("null", 1, "word")]]


def run(spark, base, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
    schema = spark.createDataFrame([], SCHEMA).schema
    keyed.stream_keyed(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", schema, ["k"], "f", audit=f"{base}/audit", glob_filter="*.parquet")
    return sorted((tuple(r) for r in spark.read.schema(schema).parquet(f"{base}/sink").collect()), key=str)


def test_first_key_wins_over_restarts(spark, tmp_path):
    want = []
    for batch, new in zip(BATCHES, ([0, 1, 3], [1, 2], [0, 1, 2, 3]), strict=True):
        want += [batch[i] for i in new]
        assert run(spark, tmp_path, batch) == sorted(want, key=str)
    assert [tuple(r) for r in ingest.batch_audit(spark, str(tmp_path / "audit")).select("batch_id", "n_input", "n_written").collect()] == [(0, 4, 3), (1, 4, 2), (2, 4, 4)]


def test_forgotten_keys_come_in_again(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "k string, f timestamp_ntz, v string"
    batches = [[("a", day(1), "x")], [("a", day(3), "known"), ("b", day(9), "y")], [("c", day(9), "z")], [("a", day(10), "again"), ("b", day(9), "more"), ("b", day(10), "known")],
               [("a", day(2), "too late")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        keyed.stream_keyed(spark, f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/ck", spark.createDataFrame([], schema).schema, ["k"], "f",
                           expire_ms=3 * 86_400_000, glob_filter="*.parquet")
    assert sorted(r["v"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/sink").collect()) == ["again", "more", "x", "y", "z"]


class Calls:
    """The rows of one bucket and its state, as the stream hands them over."""

    hasTimedOut = False

    def __init__(self):
        self.get, self.updates = None, 0

    @property
    def exists(self):
        return self.get is not None

    def update(self, value):
        self.get, self.updates = value, self.updates + 1


def test_many_keys_take_one_call_and_one_state(monkeypatch):
    """Rows of many keys, cut anywhere, are judged in one call: the first batch of a key wins, in it the smallest order."""
    import pandas as pd
    monkeypatch.setattr(keyed, "SIFT_ROWS", 7)
    pick, state, first, judge = random.Random(3), Calls(), {}, keyed.first_fetch_of(["k", "v"], None)
    for batch in range(4):
        rows = [(pick.choice([None, "null", *"abcdefghijklmnopqrst"[: 5 + 5 * batch]]), (batch, i), pick.choice([3, 4, 5, 2**63 - 1]) - batch) for i in range(200)]
        new = {k: min(o for j, _, o in rows if j == k) for k, _, _ in rows if k not in first}
        first |= new
        table = pd.DataFrame([(k, v, o, repr(k), 0) for k, v, o in rows], columns=["k", "v", "_order", "_key", "_bucket"])
        out = pd.concat(judge((0,), iter([table[i: i + 9].reset_index(drop=True) for i in range(0, 200, 9)]), state))
        assert sorted(out["v"]) == sorted(v for k, v, o in rows if first[k] == o)
        assert state.updates <= batch + 1
    known = keyed.pa.ipc.open_stream(state.get[0]).read_all().to_pydict()
    assert dict(zip(known["key"], known["first"], strict=True)) == {repr(k): o for k, o in first.items()}


def test_counts_of_more_keys_than_buckets(spark, tmp_path, monkeypatch):
    """The state has a row for each bucket, not for each key; the counts are those of the rows."""
    monkeypatch.setattr(keyed, "BUCKETS", 2)
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in range(2):
        spark.createDataFrame([(f"k{i}", batch, "v") for i in range(60 * batch, 60 * batch + 90)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        query = keyed.stream_keyed(spark, f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/ck", schema, ["k"], "f", audit=f"{tmp_path}/audit", glob_filter="*.parquet")
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    assert [tuple(r) for r in ingest.batch_audit(spark, f"{tmp_path}/audit").select("batch_id", "n_input", "n_written").collect()] == [(0, 90, 90), (1, 90, 60)]


def test_long_values_beside_nulls(spark, tmp_path, monkeypatch):
    """Whole numbers that a double cannot hold come out as they are, whatever keys share their bucket."""
    monkeypatch.setattr(keyed, "BUCKETS", 1)
    big, schema = 2**53 + 1, "k long, f long, v long"
    rows = [(None, 1, big), (big, 1, None), (big, 1, big + 2), (big + 2, 1, big + 4)]
    for _ in range(2):  # of new keys, and of known ones
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        keyed.stream_keyed(spark, f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/ck", spark.createDataFrame([], schema).schema, ["k"], "f", glob_filter="*.parquet")
    assert sorted((tuple(r) for r in spark.read.schema(schema).parquet(f"{tmp_path}/sink").collect()), key=str) == sorted(rows * 2, key=str)

import glob
import random

import pytest

from pressroom.sources import key_filter, sink

ROWS = "url string, score double, fetched long, day string, n int"


def _rows(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(3)


def test_same_rows_as_the_plain_anti_join(spark, tmp_path):
    rng = random.Random(4)
    keys = [(f"u{i}", 0.5) for i in range(60)] + [(None, 0.5), ("u1", None), (None, None), ("", 0.0), ("", -0.0)]
    seen, batch = {}, []
    for run in range(3):
        batch = [(*rng.choice(keys), run * 1000 + i, rng.choice(["2024-12-0" + str(d) for d in range(1, 6)] + [None]), i) for i in range(80)]
        batch += batch[:3]
        first = {}
        for r in batch:
            k = (r[0], r[1])
            first[k] = min(first.get(k, r[2]), r[2])
        want = [r for r in batch if (r[0], r[1]) not in seen and first[r[0], r[1]] == r[2]]
        if run:
            frame = _rows(spark, batch)
            plain = sink.new_articles(frame, str(tmp_path / "sink"), ["url", "score"], "fetched")
            found = key_filter.new_by_filter(frame, str(tmp_path / "sink"), ["url", "score"], "fetched", ["day"])
            assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
        assert key_filter.write_filtered(_rows(spark, batch), str(tmp_path / "sink"), ["url", "score"], "fetched", ["day"]) == len(want)
        seen |= first
    assert key_filter.write_filtered(_rows(spark, batch), str(tmp_path / "sink"), ["url", "score"], "fetched", ["day"]) == 0
    assert key_filter.write_filtered(_rows(spark, []), str(tmp_path / "sink"), ["url", "score"], "fetched", ["day"]) == 0
    stored = spark.read.parquet(str(tmp_path / "sink"))
    assert stored.count() == stored.select("url", "score", "fetched", "n").count() and "key" not in stored.columns


def test_only_folders_that_may_hold_a_key_are_read(spark, tmp_path):
    root = str(tmp_path / "sink")
    rows = [(f"{day}/{i}", 1.0, i, day, i) for day in ("a", "b", "c") for i in range(200)]
    key_filter.write_filtered(_rows(spark, rows), root, ["url"], "fetched", ["day"])
    for file in glob.glob(f"{root}/day=b/*.parquet"):
        with open(file, "wb") as f:
            f.write(b"no table")
    spark.catalog.clearCache()
    later = [("a/1", 1.0, 900, "c", 0), ("c/7", 1.0, 901, "a", 0), ("new", 1.0, 902, "b", 0)]
    found = key_filter.new_by_filter(_rows(spark, later), root, ["url"], "fetched", ["day"])
    assert [r["url"] for r in found.collect()] == ["new"]  # the damaged folder is not opened
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    with pytest.raises(Exception):  # noqa: B017 -- its keys are verified where the filter names it
        key_filter.new_by_filter(_rows(spark, [("b/3", 1.0, 903, "a", 0)]), root, ["url"], "fetched", ["day"]).collect()


def test_a_sink_without_filter_gets_one(spark, tmp_path):
    root = str(tmp_path / "sink")
    rows = [(f"u{i}", 1.0, i, f"d{i % 3}", i) for i in range(30)]
    sink.write_new_articles(_rows(spark, rows), root, ["url"], "fetched", partition_by=["day"])
    assert key_filter.write_filtered(_rows(spark, [*rows, ("x", 1.0, 99, "d0", 0)]), root, ["url"], "fetched", ["day"]) == 1
    with pytest.raises(ValueError):
        key_filter.new_by_filter(_rows(spark, rows), root, ["score"], "fetched", ["day"])


def test_no_key_is_lost_and_few_are_false(spark, tmp_path):
    """Every stored key names its folder; of 300 unknown keys none or one names one of 4 folders."""
    root = str(tmp_path / "sink")
    rows = spark.range(40_000).selectExpr("concat('k', id) AS url", "1.0D AS score", "id AS fetched", "concat('d', if(id < 30000, 0, id % 4)) AS day", "0 AS n")
    key_filter.write_filtered(rows, root, ["url"], "fetched", ["day"])
    keys = spark.range(300).selectExpr("concat('other', id) AS url")
    assert key_filter.folders_that_may_hold(keys, root, ["url"], ["day"]).count() <= 1
    for i in (0, 29_999, 30_001, 30_002, 30_003):
        one = spark.createDataFrame([(f"k{i}",)], "url string")
        assert f"d{0 if i < 30_000 else i % 4}" in [r["day"] for r in key_filter.folders_that_may_hold(one, root, ["url"], ["day"]).collect()]

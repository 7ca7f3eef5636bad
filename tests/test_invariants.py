"""Invariants of SURVEY 5.3 on the sf0.01 driver tables."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from pressroom.sources import sink
from pressroom.sources.tables import Tables
from tests.conftest import SF01

Q = entry_mod.queries()


def test_shares_sum_to_100_or_0_per_key(spark):
    s = Q["emotion_share"](spark, SF01)
    sums = s.groupBy("Year-Month-Media").agg(F.sum("Ratio").alias("r")).collect()
    assert sums and all(abs(r.r - 100.0) < 1e-9 or r.r == 0.0 for r in sums)


def test_group_month_offsets_stack_to_100(spark):
    g = Q["group_month_share"](spark, SF01)
    last = g.groupBy("group", "Year-Month").agg(F.max_by(F.col("start") + F.col("mean_ratio"), "pos").alias("top"))
    assert all(abs(r.top - 100.0) < 1e-4 or abs(r.top) < 1e-9 for r in last.collect())


def test_visible_plus_hidden_is_non_null_total(spark):
    v = {r.press_name: r.n_hidden + r.n_shown for r in Q["visibility_by_press"](spark, SF01).collect()}
    t = Tables(spark, SF01)
    exp = {r.source: r.n for r in t.documents.join(t.labels, "doc_id").groupBy("source")
           .agg(F.count("toxic").alias("n")).collect()}
    assert v == exp
    overall = Q["visibility_overall"](spark, SF01).collect()
    assert abs(sum(r.pct for r in overall) - 100.0) < 1e-9


def test_running_counters_end_at_totals(spark):
    a = Q["ingest_audit"](spark, SF01)
    last = a.orderBy(F.desc("ts"), F.desc("event_id")).first()
    totals = {r.status: (r.n_fetches, r.n_comments) for r in Q["audit_totals"](spark, SF01).collect()}
    assert last.seq == sum(n for n, _ in totals.values()) == a.count()
    assert last.ok_count == totals["ok"][0] and last.fail_count == totals["failed"][0]
    assert last.total_comments == totals["ok"][1] + totals.get("duplicate", (0, 0))[1]


def test_month_to_date_last_file_equals_month_mean(spark):
    mtd = Q["mean_scores_month_to_date"](spark, SF01)
    last = mtd.groupBy("press_name", "month").agg(F.max_by("article", "doc_id").alias("a"),
                                                  F.max("n_comments").alias("n"))
    month = {(r.press_name, r.month): (r.article, r.n_comments) for r in Q["mean_scores_month"](spark, SF01).collect()}
    for r in last.collect():
        assert (r.a, r.n) == month[(r.press_name, r.month)]


def test_round_trip_keeps_every_row(spark):
    assert Q["press_tree_roundtrip"](spark, SF01).count() == Tables(spark, SF01).events.count()


def test_reingest_adds_nothing(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="pressroom-inv-"), "sink")
    e = Tables(spark, SF01).events.select(F.col("event_type").alias("press_name"),
                                          F.date_format("ts", "yyyy-MM-dd").alias("date"),
                                          F.col("user_id").cast("string").alias("title"),
                                          F.col("event_id").alias("fetch_seq"))
    first = sink.write_new_articles(e, out)
    assert first > 0 and sink.write_new_articles(e, out) == 0
    keys = spark.read.parquet(out).select("date", "press_name", "title").distinct().count()
    assert keys == e.select("date", "press_name", "title").distinct().count() == first

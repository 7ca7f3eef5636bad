"""Plan-shape checks: Python only where it is needed, pushdown and pruning reach
the scan, broadcasts where promised, top-N as a window group limit, no global window over
the whole audit log."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry_mod
from pressroom.plans.registry import REGISTRY
from tests.conftest import SF01

QUERIES = {name: entry_mod.queries()[name] for name in REGISTRY}
# file parsing and the HTML tokenizer run in Arrow batches, plug-in scorers in a pandas UDF
PYTHON_OK = {"press_tree_roundtrip", "press_tree_raw", "raw_tree_files", "merged_csv_roundtrip", "merged_csv_by_press", "extract_links", "distinct_links",
             "links_as_parsed", "mean_scores_by_label", "top_tokens_plugin", "mean_scores_day", "emotion_report"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonUDF", "MapInArrow")


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_OK - {"stream_first_fetch"}))
def test_no_python_in_catalyst_jobs(spark, name):
    p = plan(QUERIES[name](spark, SF01))
    assert not any(n in p for n in PYTHON_NODES), f"{name} has a Python node"


def test_column_pruning_and_pushdown(spark):
    p = plan(QUERIES["visibility_by_press"](spark, SF01))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in p
    p = plan(QUERIES["orders_in_period"](spark, SF01))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(o_orderdate", p), p


def test_broadcast_for_dimensions(spark):
    for name in ("group_of_press", "lookup_nation_name", "box_stats_events"):
        p = plan(QUERIES[name](spark, SF01))
        assert "BroadcastHashJoin" in p, name


def test_top_n_uses_window_group_limit(spark):
    p = plan(QUERIES["top_tokens_by_lang"](spark, SF01))
    assert p.count("WindowGroupLimit") >= 2


def test_audit_window_is_partitioned_by_bucket(spark):
    p = plan(QUERIES["ingest_audit"](spark, SF01), "extended")
    physical = p.split("== Physical Plan ==")[1]
    # rows are partitioned by the (bucket) surrogate key, never gathered into one partition
    assert re.search(r"Exchange hashpartitioning\(_jk#", physical), physical


def test_share_summary_computed_once(spark):
    p = plan(QUERIES["group_month_share"](spark, SF01))
    scans = re.findall(r"^\(\d+\) Scan parquet", p, flags=re.M)
    assert len(scans) == 3, p  # lineitem, orders, customer -- once each


@pytest.mark.parametrize("name", ["top_tokens_by_lang", "first_fetch_per_key", "article_index",
                                  "visibility_by_press", "audit_totals", "mean_scores_month"])
def test_grouped_steps_aggregate_before_the_shuffle(spark, name):
    """A hot key ships one partial row per task: every grouped step has a partial aggregate
    below its exchange."""
    p = plan(QUERIES[name](spark, SF01))
    assert re.search(r"Functions \[\d+\]: \[partial_", p), p


def test_member_filter_reaches_the_scan(spark):
    p = plan(QUERIES["comments_of_members"](spark, SF01))
    assert re.search(r"PushedFilters: \[.*In\(source", p), p

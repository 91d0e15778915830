"""Plan guards: properties every registered query's physical plan must keep."""

import contextlib
import io
import re

import __spark_entry__ as entry

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_cross_joins_or_python_in_registered_queries(spark):
    # these run whole jobs on the way and return a scan of what they stored
    jobs = {"stream_ingest", "stream_deltas", "stream_windows", "message_log_sink",
            "message_log_ingest", "ingest_interrupted", "ingest_deltas"}
    for name, fn in entry.QUERIES.items():
        if name in jobs:
            continue
        plan = _plan(fn(spark, entry.SMOKE_DIR))
        for op in FORBIDDEN:
            assert op not in plan, f"{name}: {op}"


def test_scans_read_only_needed_columns(spark):
    full = {"events": 6, "lineitem": 11, "orders": 6, "customer": 5}
    for name in ("insights_daily", "budget_status", "spend_totals", "audit_unique"):
        plan = _plan(entry.QUERIES[name](spark, entry.SMOKE_DIR))
        for block in plan.split("\n\n"):
            m = re.search(r"Location: .*?/(\w+)\.parquet", block)
            read = re.search(r"ReadSchema: struct<(.*)>", block)
            if m and read and m.group(1) in full:
                assert len(read.group(1).split(",")) < full[m.group(1)], (name, m.group(1))


def test_insight_date_filter_reaches_the_scan(spark):
    plan = _plan(entry.QUERIES["insights_filtered"](spark, entry.SMOKE_DIR))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,", plan)
    assert re.search(r"PushedFilters: \[.*LessThan\(ts,", plan)


def test_rollup_is_partial_then_final_aggregate(spark):
    plan = _plan(entry.QUERIES["insights_daily"](spark, entry.SMOKE_DIR))
    assert plan.count("HashAggregate") >= 2 and "partial_sum" in plan

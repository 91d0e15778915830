"""Skew check: does any task receive a hot key whole?

Usage: python tools/skew_check.py [sf_dir] [event_log_dir]

Derives a skewed input from the driver ``events`` table - every third event is moved to one
hot campaign, so one dedup key holds a third of the rows - runs the exact TTL dedup on it
(the hot key goes through the heavy path), a daily roll-up and a last-wins dedup keyed by the
campaign, with Spark's event log written
to a scratch folder. Prints, per stage that reads a shuffle, the shuffle records of the
largest task next to the stage's total, plus the hot key's row count: a task that received
the whole hot key would show it. (Scan stages are left out: a small input file is one task.)
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from adperf.operators import dedup, rollup, validate  # noqa: E402
from adperf.session import build_session  # noqa: E402
from adperf.sources import tables  # noqa: E402


def _event_lines(log_dir: str):
    """Lines of every event log file under ``log_dir`` (rolling logs, zstd or plain)."""
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True)
                       + glob.glob(os.path.join(log_dir, "*.zstd"))):
        if path.endswith(".zstd"):
            import zstandard
            with open(path, "rb") as fh:
                data = zstandard.ZstdDecompressor().stream_reader(fh).read()
            yield from data.decode().splitlines()
        elif os.path.isfile(path):
            with open(path) as fh:
                yield from fh


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="adperf-evlog-")
    # partition coalescing off: at test scale AQE would merge every shuffle into one task
    spark = build_session("local[8]", 16, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    events = tables.table(spark, sf_dir, "events")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1))
                            .otherwise(F.col("user_id")))
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir, events=hot),
                                          ("platform", "campaign_id"))
    facts = validate.accepted(validate.validate(raw, now=F.col("received_at"),
                                                processed_at=F.col("processed_at")))
    hot_rows = facts.filter(F.col("campaign_id") == 1).count()
    kept = dedup.first_wins_ttl(facts, light_limit=10_000)
    n_kept = kept.count()
    n_daily = rollup.daily_insights(facts).count()
    # last-wins keyed by the hot campaign itself: the aggregate combines map-side
    n_last = dedup.last_wins(facts, ["campaign_id"], ["processed_at", "id"]).count()
    spark.stop()

    report = {"hot_key_rows": hot_rows, "accepted_rows": n_kept, "daily_rows": n_daily,
              "last_wins_rows": n_last,
              "stages": shuffle_stages(log_dir)}
    report.update(join_skew(sf_dir, os.path.join(log_dir, "join")))
    report["largest_shuffle_task_records"] = max(
        (s["max_task_records"] for s in report["stages"]), default=0)
    print(json.dumps(report))


def join_skew(sf_dir: str, log_dir: str) -> dict:
    """The flagship roll-up with the customer join forced to a sort-merge join (as it would be
    at full scale) and AQE's skew thresholds scaled down to test size: does AQE split the hot
    campaign's partition?"""
    os.makedirs(log_dir, exist_ok=True)
    spark = build_session("local[8]", 16, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"})
    events = tables.table(spark, sf_dir, "events")
    # the test file is one Parquet file (one map task); AQE splits a skewed partition along
    # map outputs, so spread the input as a many-file table would be
    hot = (events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1))
                             .otherwise(F.col("user_id")))
           .repartition(16))
    facts = validate.accepted(validate.validate(
        tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir, events=hot)),
        now=F.col("received_at"), processed_at=F.col("processed_at")))
    n = rollup.daily_insights(facts).count()
    spark.stop()
    st = shuffle_stages(log_dir)
    return {"join_daily_rows": n, "join_stages": st,
            "join_largest_shuffle_task_records": max((s["max_task_records"] for s in st),
                                                     default=0)}


def shuffle_stages(log_dir: str) -> list[dict]:
    """Per stage that reads a shuffle: task count, largest task's records, total records."""
    stages: dict[int, list[int]] = {}
    for line in _event_lines(log_dir):
        if not line.strip():
            continue
        ev = json.loads(line)
        if ev.get("Event") != "SparkListenerTaskEnd":
            continue
        m = ev.get("Task Metrics") or {}
        recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
        stages.setdefault(ev["Stage ID"], []).append(recs)
    return [{"stage": s, "tasks": len(v), "max_task_records": max(v), "total_records": sum(v)}
            for s, v in sorted(stages.items()) if sum(v)]


if __name__ == "__main__":
    main()

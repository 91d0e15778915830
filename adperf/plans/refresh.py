"""Refresh of stored insights (A8 on tables) and recovery of runs that stopped on the way."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.operators import rollup
from adperf.sources import journal, storage


def refresh_days(spark: SparkSession, root: str, days: list[dt.date], updated_at: Column,
                 in_stream: bool = False) -> DataFrame | None:
    """Replace the insights of ``days``. Only the facts of those days are read, and nothing of
    the insight table is, so a repeat gives the same table whatever an earlier run left."""
    if not days:
        return None
    live = storage.live_days(spark, root, days)
    fresh = rollup.insights_of(storage.read_facts(spark, root, days=live), updated_at)
    if live:
        storage.write_insights(fresh, root, in_stream)
    storage.empty_insights(spark, root, sorted(set(days) - set(live)))
    return fresh


def recover(spark: SparkSession, root: str, batch_id: str | int | None = None,
            updated_at: Column | None = None, in_stream: bool = False) -> list[str]:
    """Bring runs that stopped on the way to an end; returns their batches.

    A run that was not switched is undone: no reader has seen it. A switched one is finished:
    the days of both its runs are refreshed (where insights are deltas, they count already),
    then what it replaced is deleted. ``batch_id``
    limits this to one batch (whose next run does it first); without it every open record is
    taken, so nothing else may be writing to the store meanwhile.
    """
    if batch_id is None:
        records = journal.open_records(spark, root)
    else:
        found = journal.open_record(spark, root, journal.batch_name(batch_id))
        records = [found] if found else []
    for record in records:
        if not record.switched:
            storage.undo_run(spark, root, record)
            continue
        if record.kind == "table":
            stamp = updated_at if updated_at is not None else F.localtimestamp()
            refresh_days(spark, root, storage.changed_days(record), stamp, in_stream)
        storage.finish_run(spark, root, record)
    return [r.batch for r in records]

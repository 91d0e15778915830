"""Retention of a store: whole days older than a bound go.

Every table lies by day, so this deletes folders and reads no row. Facts and what is derived
from them keep one bound; the dedup state is never read beyond one TTL window before an arrival
and has its own. Days go oldest table first (insights before the facts they come from), so a
reader never finds insights recomputed from less; run again after a stop, it goes on.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import SparkSession

from adperf import schemas as S
from adperf.sources import journal, storage


def expire(spark: SparkSession, root: str, keep_from: dt.date,
           arrived: dt.datetime | None = None) -> dict[str, list[str]]:
    """Delete days before ``keep_from`` of insights, deltas and facts, and dedup state that no
    batch arriving at ``arrived`` (default: now) or later can read. Returns the days deleted by
    table. Nothing may be writing to the store meanwhile."""
    if open_ := journal.open_records(spark, root):
        raise ValueError(f"batches {[r.batch for r in open_]} are under way; recover them first")
    arrived = arrived if arrived is not None else dt.datetime.now(dt.UTC).replace(tzinfo=None)
    state_from = (arrived - dt.timedelta(days=S.DEDUP_TTL_DAYS)).date()
    bounds = ((storage.INSIGHTS, keep_from), (storage.DELTAS, keep_from),
              (storage.FACTS, keep_from), (storage.DEDUP_STATE, state_from))
    gone: dict[str, list[str]] = {}
    for name, bound in bounds:
        for day, folder in storage.day_folders(spark, root, name).items():
            if day != storage.NO_DAY and day < bound.isoformat():
                journal.delete(spark, os.path.join(root, name, folder))
                gone.setdefault(name, []).append(day)
    return gone

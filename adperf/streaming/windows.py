"""Live insights of open days by a windowed streaming aggregate (T3), late rows to the day
refresh (T4).

Two streaming queries read the same events. The *window* query keeps the sums of the open days
in the state store: ``window`` of a day on the event time, a watermark ``delay`` behind the
latest event, update mode; each micro-batch writes the rows it changed, and a replayed one its
own again. A day is closed when the watermark has passed its end: then its state is dropped, and
the window query ignores rows that still come for it. None is lost: the *facts* query
(:class:`WindowRun`) stores every row, late or not, and recomputes closed days from the stored
facts, once when they are found closed and again whenever a late row touches them. It leaves the
open days alone, so a day in progress is not read again with every micro-batch.

The window query sums what it is given, so its source must bring each event once (a message log
does); facts are deduplicated as in any other ingest, and so are closed days.
"""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adperf import schemas as S
from adperf.operators import rollup
from adperf.plans.ingest import BatchRun
from adperf.plans.refresh import refresh_days
from adperf.sources import journal, storage

LIVE = "live"
DELAY = "2 days"
EPOCH_START = dt.date(1970, 1, 1)


def daily_windows(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Sums per day window and insight key of a stream of valid events, in update mode."""
    keys = [k for k in S.INSIGHT_KEY if k != "date"]
    # watermark and windows work on instants: the wall time is taken as one of UTC, whatever
    # the session's zone
    at = events.withColumn("_at", F.from_utc_timestamp(
        F.col("event_time").cast("timestamp"), F.current_timezone()))
    sums = at.withWatermark("_at", delay).groupBy(F.window("_at", "1 day").alias("w"), *keys).agg(
        *rollup.metric_sums())
    day = F.floor(F.unix_seconds("w.start") / F.lit(86400)).cast("int")
    return sums.select(F.date_from_unix_date(day).alias("date"), *keys, *S.METRICS)


def start(prepared: DataFrame, root: str, checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    """The window query over checked events (``streaming.ingest.prepare``), until nothing more is
    available; call :func:`note_watermark` when it has ended."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, LIVE, f"epoch={epoch}"))

    good = prepared.filter(F.col("reject_reason").isNull())
    return (daily_windows(good, delay).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def note_watermark(spark: SparkSession, query: StreamingQuery, root: str) -> dt.date:
    """Store how far days are closed by the window query's watermark; never goes back."""
    progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    seen = [p["eventTime"]["watermark"] for p in progress
            if p.get("eventTime", {}).get("watermark")]
    until = max([closed_until(spark, root), *(dt.date.fromisoformat(w[:10]) for w in seen)])
    _put(spark, root, "_closed", until)
    return until


def _put(spark: SparkSession, root: str, name: str, day: dt.date) -> None:
    journal.write_text(spark, os.path.join(root, LIVE, name), day.isoformat())


def _get(spark: SparkSession, root: str, name: str) -> dt.date:
    text = journal.read_text(spark, os.path.join(root, LIVE, name))
    return dt.date.fromisoformat(text) if text else EPOCH_START


def closed_until(spark: SparkSession, root: str) -> dt.date:
    """Days before this one are closed."""
    return _get(spark, root, "_closed")


class WindowRun(BatchRun):
    """Stores facts as any run, and recomputes closed days only: those that rows of this run or
    of the run it replaces belong to, and those closed since the last run."""

    def refresh(self) -> None:
        spark, root = self.spark, self.root
        until, settled = closed_until(spark, root), _get(spark, root, "_settled")
        touched = {d for d in storage.changed_days(self.record) if d < until}
        newly = {d for d in storage.fact_days(spark, root) if settled <= d < until}
        refresh_days(spark, root, sorted(touched | newly), self.stamp, self.in_stream)
        if until > settled:
            _put(spark, root, "_settled", until)


def settle(spark: SparkSession, root: str, stamp) -> None:
    """Recompute the days closed since the last run of the facts query."""
    until, settled = closed_until(spark, root), _get(spark, root, "_settled")
    newly = [d for d in storage.fact_days(spark, root) if settled <= d < until]
    refresh_days(spark, root, newly, stamp)
    _put(spark, root, "_settled", max(until, settled))


def read_insights(spark: SparkSession, root: str) -> DataFrame:
    """Insights of all days: settled ones from the table, the others from the windows (the last
    micro-batch that changed a row counts)."""
    settled = _get(spark, root, "_settled")
    closed = storage.read_insights(spark, root, end=settled - dt.timedelta(days=1),
                                   schema=None)
    epochs = journal.children(spark, os.path.join(root, LIVE))
    if not epochs:
        return storage.read_insights(spark, root).select(*S.INSIGHT_COLUMNS)
    live = spark.read.option("basePath", os.path.join(root, LIVE)).parquet(
        *[os.path.join(root, LIVE, e) for e in epochs]).filter(F.col("date") >= F.lit(settled))
    last = live.groupBy(*S.INSIGHT_KEY).agg(
        F.max(F.struct("epoch", *S.METRICS)).alias("_last")).select(*S.INSIGHT_KEY, "_last.*")
    opened = rollup.daily_sums_to_insights(last).select(*S.INSIGHT_COLUMNS)
    return opened if closed is None else closed.select(*S.INSIGHT_COLUMNS).unionByName(opened)

"""Streaming ingest.

``source -> decode -> validate -> foreachBatch``. Each micro-batch:

1. takes the first row per dedup key, unless an earlier batch accepted the key within the TTL
   before this one arrived (the dedup-state table, shared with batch ingest);
2. writes its facts, rejects and accepted keys as a run of batch ``<epoch>`` - a replayed epoch
   first undoes or finishes what its earlier attempt left, then replaces it, so a restart from
   the checkpoint never duplicates facts;
3. recomputes the days it touched from their stored facts and replaces those days of the
   insight table.

Events are judged by arrival, not by their own time: a late row simply touches an older day,
which is recomputed, and nothing needs a watermark. Sums are never incremented in place, so
replays cannot double count (T2).
"""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.plans.ingest import BatchRun, checked_events
from adperf.session import checkpoint_dir


def prepare(stream: DataFrame, fact_schema=None, now: Column | None = None,
            processed_at: Column | None = None) -> DataFrame:
    """Decode (when the stream carries ``value``) and validate a stream of events.

    Accepted and rejected rows stay together, told apart by ``reject_reason`` (decode failures
    included), so a micro-batch reads its source once.
    """
    return checked_events(stream, now, processed_at, fact_schema)


def batch_writer(root: str, updated_at: Column | None = None, dedup: bool = True,
                 arrived=None, how: type[BatchRun] = BatchRun):
    """The ``foreachBatch`` function: dedup, store, refresh touched days (or add deltas, by
    ``how``: see ``plans.deltas``).

    ``arrived`` maps an epoch to its arrival stamp (default: the wall clock when it is run).
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # first of all: the look for a row may run all before it
        try:
            if batch.isEmpty():
                return
            good = batch.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw_value")
            rejects = batch.filter(F.col("reject_reason").isNotNull())
            stamp = updated_at if updated_at is not None else F.localtimestamp()
            at = arrived(epoch_id) if arrived is not None \
                else dt.datetime.now(dt.UTC).replace(tzinfo=None)
            how(spark, good, rejects, root, epoch_id, at, stamp, ttl_dedup=dedup,
                in_stream=True).run()
        finally:
            batch.unpersist()

    return write


def start(prepared: DataFrame, root: str, checkpoint: str, available_now: bool = True,
          processing_time: str | None = None, updated_at: Column | None = None,
          dedup: bool = True, arrived=None, how: type[BatchRun] = BatchRun):
    """Run the ingest as one streaming query; returns the ``StreamingQuery``."""
    w = (prepared.writeStream.foreachBatch(batch_writer(root, updated_at, dedup, arrived, how))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else \
        w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def keep_running(begin, attempts: int = 5, backoff: float = 1.0, sleep=time.sleep):
    """Run a streaming query to its end through failures.

    ``begin`` starts the query anew from its checkpoint. After a failure the next start waits
    ``backoff`` seconds, twice as long each time; a start that makes progress (stores another
    epoch) sets the count back. After ``attempts`` failures in a row the last one is raised.
    """
    failed = 0
    while True:
        query = begin()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            failed = 1 if any(p["numInputRows"] for p in query.recentProgress) else failed + 1
            if failed >= attempts:
                raise
            sleep(backoff * 2 ** (failed - 1))


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def run(stream: DataFrame, root: str, checkpoint: str, fact_schema=None, dedup: bool = True,
        now: Column | None = None, processed_at: Column | None = None,
        available_now: bool = True, processing_time: str | None = None, arrived=None,
        how: type[BatchRun] = BatchRun):
    """T1 in one call: ``prepare`` + ``start``. Returns the ``StreamingQuery``."""
    prepared = prepare(stream, fact_schema, now=now, processed_at=processed_at)
    return start(prepared, root, checkpoint, available_now=available_now,
                 processing_time=processing_time, dedup=dedup, arrived=arrived, how=how)

"""Batch ingest job: the streaming chain run once over a finite input.

``raw events (or JSON messages) -> decode -> validate -> first-wins dedup by arrival -> store
facts, rejects and dedup state under a batch id -> recompute the touched days of the insight
table``. Batches and micro-batches share one dedup state, so a message redelivered in a later
batch within the TTL is not counted again. Re-running a batch id replaces all that its earlier
run stored, on other days too, and recomputes the days of both runs; an interrupted run is
simply run again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adperf.operators import dedup, validate
from adperf.functions.dates import ntz
from adperf.plans.refresh import recover, refresh_days
from adperf.session import checkpoint_dir
from adperf.sources import events as ev
from adperf.sources import journal, storage


def checked_events(incoming: DataFrame, now: Column | None = None,
                   processed_at: Column | None = None, fact_schema=None) -> DataFrame:
    """Decoded (when ``incoming`` carries ``value``) and validated events."""
    if "value" not in incoming.columns:
        return validate.validate(incoming, now=now, processed_at=processed_at)
    decoded = ev.decode_events(incoming, fact_schema) if fact_schema is not None \
        else ev.decode_events(incoming)
    return validate.validate(decoded, now=now, processed_at=processed_at,
                             prior=F.col("decode_error"), keep=("raw_value",))


class BatchRun:
    """One run of a batch, step by step: the part that batches and micro-batches share.

    ``begin`` recovers what an earlier run of the batch left and opens the journal record;
    ``facts`` (dedup against the state), ``rejects`` and ``state`` write into folders of this
    run, which nobody reads yet; ``switch`` makes them count, in place of the batch's earlier
    run; ``refresh`` recomputes the insights of the days of both; ``finish`` deletes the earlier
    run and closes the record.
    """

    STEPS = ("begin", "facts", "rejects", "state", "switch", "refresh", "finish")
    KIND = "table"

    def __init__(self, spark: SparkSession, good: DataFrame, rejects: DataFrame, root: str,
                 batch_id: str | int, arrived: dt.datetime, stamp: Column,
                 ttl_dedup: bool = True, mode: str = "first", in_stream: bool = False) -> None:
        self.spark, self.root, self.batch_id = spark, root, batch_id
        self.good, self.bad, self.arrived, self.stamp = good, rejects, arrived, stamp
        self.ttl_dedup, self.mode, self.in_stream = ttl_dedup, mode, in_stream

    def run(self, steps: int | None = None) -> None:
        """The first ``steps`` steps; all of them, unless a stop on the way is wanted."""
        for name in self.STEPS[:steps]:
            getattr(self, name)()

    def begin(self) -> None:
        recover(self.spark, self.root, self.batch_id, self.stamp, self.in_stream)
        self.record = journal.begin(self.spark, self.root, self.batch_id, self.KIND)

    def facts(self) -> None:
        kept = self.good
        if self.ttl_dedup and self.mode == "last":
            kept = dedup.last_wins(kept, ["deduplication_key"], ["processed_at", "id"])
        elif self.ttl_dedup:
            kept = dedup.first_wins_arrival(
                kept, ntz(self.arrived),
                storage.read_dedup_state(self.spark, self.root, self.arrived, self.batch_id),
                state_partitions=storage.state_buckets(self.spark, self.root))
        storage.write_run_facts(kept, self.root, self.record, self.in_stream)

    def rejects(self) -> None:
        storage.write_run_rejects(self.bad, self.root, self.record, self.in_stream)

    def state(self) -> None:
        stored = storage.read_run(self.spark, self.root, self.record)
        # a run that accepts nothing, or keeps no state, leaves none of an earlier run's either
        if self.ttl_dedup and self.mode == "first" and stored is not None:
            storage.write_run_state(stored, self.root, self.record, self.arrived)

    def switch(self) -> None:
        self.record = storage.switch_run(self.spark, self.root, self.record)

    def refresh(self) -> None:
        refresh_days(self.spark, self.root, storage.changed_days(self.record), self.stamp,
                     self.in_stream)

    def finish(self) -> None:
        storage.finish_run(self.spark, self.root, self.record)


def ingest_batch(spark: SparkSession, incoming: DataFrame, root: str, batch_id: str | int,
                 now: Column | None = None, processed_at: Column | None = None,
                 ttl_dedup: bool = True, fact_schema=None, mode: str = "first",
                 arrived: dt.datetime | None = None, steps: int | None = None,
                 how: type[BatchRun] = BatchRun) -> dict:
    """Run one ingest batch; returns row counts (accepted, duplicates, rejected).

    ``how`` is the kind of run: insights as a table of whole days, or as deltas
    (``plans.deltas.DeltaRun``). ``steps`` stops it after some of its steps, as a crash would: a
    drill for recovery, after which ``accepted`` counts what the batch's last finished run holds.

    ``mode="first"`` (default) keeps the first row per dedup key unless an earlier batch
    accepted the key within the TTL before this one ``arrived`` (default: the wall clock);
    ``mode="last"`` keeps the latest version per dedup key (by ``processed_at``, then id) so
    that a corrected re-fetch of a day replaces the earlier figure.
    """
    if mode not in ("first", "last"):
        raise ValueError("mode must be 'first' or 'last'")
    arrived = arrived if arrived is not None else dt.datetime.now(dt.UTC).replace(tzinfo=None)
    seen = Observation("ingest")
    checked = checked_events(incoming, now, processed_at, fact_schema).observe(
        seen, F.count_if(F.col("reject_reason").isNull()).alias("good"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("bad"))
    checkpoint_dir(spark)
    checked = checked.checkpoint(eager=True)  # one decode + validation pass for both outputs
    how(spark, validate.accepted(checked).drop("raw_value"), validate.rejected(checked), root,
        batch_id, arrived, F.localtimestamp(), ttl_dedup, mode).run(steps)
    stored = storage.read_batch(spark, root, batch_id)
    kept, counts = 0 if stored is None else stored.count(), seen.get
    return {"accepted": kept, "duplicates": counts["good"] - kept, "rejected": counts["bad"]}

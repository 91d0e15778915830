"""Insights as deltas (A8): a batch adds its own sums and never recomputes a day.

A run writes, next to its facts, what it changes in the daily sums: plus the fact versions that
win, minus those they replace (:func:`adperf.operators.rollup.insight_deltas`). Both come to
count by the same journal switch, so insights and facts never disagree, and there is nothing to
refresh after it. Reading sums the delta rows of a day per insight key.

Of the stored facts a new batch needs those of its own fact keys, of the days it touches: a semi
join in which the batch's keys are broadcast while they are few (``BROADCAST_KEYS``), so the
day's facts are scanned by column where they lie, and neither shuffled nor aggregated; with more
keys both sides are shuffled.

Deltas of a day lie in generations, of which the highest counts. A batch that is run *again* may
take back facts that later batches have replaced meanwhile, so its days (of both runs) are
summed anew from the facts into a new generation. Compaction does the same from the deltas.

One writer at a time, as for all ingest into a store.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.operators import rollup
from adperf.plans.ingest import BatchRun
from adperf.sources import journal, storage

BROADCAST_KEYS = 500_000


class DeltaRun(BatchRun):
    """A :class:`BatchRun` whose insights are deltas, written before the switch."""

    STEPS = ("begin", "facts", "rejects", "state", "deltas", "switch", "finish")
    KIND = "deltas"

    def deltas(self) -> None:
        spark, root, record = self.spark, self.root, self.record
        new = storage.read_run(spark, root, record)
        if record.old_run or new is not None:
            deltas = self._anew(new) if record.old_run else self._added(new)
            storage.write_run_deltas(deltas, root, record, self.in_stream)

    def _added(self, new: DataFrame) -> DataFrame:
        days = storage.run_days(self.spark, self.root, self.record)
        keys = new.select(*S.FACT_KEY).distinct()
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        live = storage.live_days(self.spark, self.root, days)
        before = None
        if live:
            before = storage.read_facts(self.spark, self.root, days=live).join(
                keys, list(S.FACT_KEY), "left_semi")
        counted = storage.delta_days(self.spark, self.root, days=days)
        return rollup.insight_deltas(new, before).withColumn("generation", _number(counted))

    def _anew(self, new: DataFrame | None) -> DataFrame:
        """All sums of the days of both runs, as the next generation; a day without a fact left
        has zeros there, so that nothing of it counts."""
        own = storage.run_days(self.spark, self.root, self.record) if new is not None else []
        days = sorted({*own, *map(dt.date.fromisoformat, self.record.old_days)})
        facts = storage.read_facts(self.spark, self.root, days=days, as_if=self.record)
        counted = storage.delta_days(self.spark, self.root, days=days)
        return _next_generation(rollup.insight_deltas(facts, None), days, counted)


def _next_generation(sums: DataFrame, days: list[dt.date], counted: dict[str, int]) -> DataFrame:
    """``sums`` as the next generation of ``days``, each with a row of zeros beside them."""
    zeros = sums.sparkSession.createDataFrame([(d,) for d in days], "date date").select(
        *[F.col("date") if c == "date" else F.lit(0 if c in (*S.METRICS, "n_facts") else None)
          .cast(sums.schema[c].dataType).alias(c) for c in sums.columns])
    return sums.unionByName(zeros).withColumn(
        "generation", _number({d: g + 1 for d, g in counted.items()}))


def _number(counted: dict[str, int]) -> Column:
    """The generation of each row's ``date``; 0 for days not ``counted``."""
    if not counted:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for d, g in counted.items()
                           for x in (dt.date.fromisoformat(d), g)])
    return F.coalesce(known[F.col("date")], F.lit(0))


def read_delta_insights(spark: SparkSession, root: str, start: dt.date | None = None,
                        end: dt.date | None = None, updated_at: Column | None = None
                        ) -> DataFrame:
    """S6 of a store with deltas: daily insights of the whole days ``start..end``."""
    deltas = storage.read_deltas(spark, root, storage.delta_days(spark, root, start, end))
    if deltas is None:
        return spark.createDataFrame([], S.INSIGHT_SCHEMA).select(*S.INSIGHT_COLUMNS)
    return rollup.insights_of_deltas(deltas, updated_at)


def compact(spark: SparkSession, root: str, start: dt.date | None = None,
            end: dt.date | None = None) -> list[str]:
    """Sum the deltas of each day of ``start..end`` that has more than one run of them into a new
    generation; returns the days. Nothing that can be read changes."""
    counted = {d: g for d, g in storage.delta_days(spark, root, start, end).items()
               if len(storage.generations(spark, root, d)[g]) > 1}
    if not counted:
        return []
    record = journal.begin(spark, root, "compaction", "compact")
    merged = rollup.merge_deltas(storage.read_deltas(spark, root, counted))
    days = [dt.date.fromisoformat(d) for d in counted]
    storage.write_run_deltas(_next_generation(merged, days, counted), root, record)
    record = journal.switch(spark, root, record, sorted(counted))
    storage.finish_run(spark, root, record)
    return record.days

"""Insights as deltas: equal to the roll-up of the facts that count, after every stop."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import ntz
from adperf.operators import rollup
from adperf.plans import deltas
from adperf.plans.ingest import ingest_batch
from adperf.plans.refresh import recover
from adperf.sources import journal, storage

SCHEMA = S.event_schema(T.LongType())
T0 = dt.datetime(2024, 1, 1, 6)
DAY = dt.timedelta(days=1)
STEPS = deltas.DeltaRun.STEPS


def _rows(spark, seed, n=40, days=3, shift=0):
    """Facts of which many share a fact key with facts of other seeds, in other versions."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        key = rng.randrange(30)
        version = T0 + rng.randrange(4) * DAY
        out.append((rng.randrange(9), 1 + key % 3, "meta", "view", rng.randrange(50), 1, 0,
                    Decimal(rng.randrange(900)) / 1000, Decimal("0.1"), T0 + (key % days + shift) * DAY,
                    rng.choice(["EU", "US"]), "USD", f"k{key}", version, version))
    return spark.createDataFrame(out, SCHEMA)


def _run(spark, root, batch, df, steps=None):
    from pyspark.sql import functions as F
    ingest_batch(spark, df, root, batch, now=ntz(T0), processed_at=F.col("processed_at"),
                 fact_schema=SCHEMA, arrived=T0, ttl_dedup=False, steps=steps,
                 how=deltas.DeltaRun)


def _check(spark, root):
    """The merged deltas equal the roll-up of the stored facts; returns the number of rows."""
    cols = list(S.INSIGHT_COLUMNS)
    got = sorted(map(tuple, deltas.read_delta_insights(spark, root).select(cols).collect()))
    facts = storage.read_facts(spark, root)
    want = sorted(map(tuple, rollup.insights_of(facts).select(cols).collect()))
    assert got == want
    return len(got)


def test_versions_that_win_lose_and_repeat(spark, tmp_root):
    for seed in range(4):
        _run(spark, tmp_root, f"b{seed}", _rows(spark, seed))
        assert _check(spark, tmp_root) > 0
    _run(spark, tmp_root, "b4", _rows(spark, 3))  # the same rows once more
    _check(spark, tmp_root)
    assert len(deltas.compact(spark, tmp_root)) == 3
    assert deltas.compact(spark, tmp_root) == []
    _check(spark, tmp_root)
    _run(spark, tmp_root, "b5", _rows(spark, 9))
    _check(spark, tmp_root)
    part = deltas.read_delta_insights(spark, tmp_root, dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    assert {r.date for r in part.collect()} == {dt.date(2024, 1, 2)}


def test_a_run_again_sums_its_days_anew(spark, tmp_root):
    _run(spark, tmp_root, "b0", _rows(spark, 0))
    _run(spark, tmp_root, "b1", _rows(spark, 1))  # takes back what it replaces of b0
    _run(spark, tmp_root, "b0", _rows(spark, 5, shift=1))
    _check(spark, tmp_root)
    _run(spark, tmp_root, "b1", _rows(spark, 1).limit(0))
    _check(spark, tmp_root)
    _run(spark, tmp_root, "b0", _rows(spark, 1).limit(0))
    assert _check(spark, tmp_root) == 0


@pytest.mark.parametrize("steps", range(1, len(STEPS)))
def test_a_stop_after_each_step_leaves_facts_and_insights_agreeing(spark, tmp_root, steps):
    _run(spark, tmp_root, "b0", _rows(spark, 0))
    _run(spark, tmp_root, "b1", _rows(spark, 1), steps=steps)  # a first run
    before = _check(spark, tmp_root)
    recover(spark, tmp_root)
    assert _check(spark, tmp_root) == before
    _run(spark, tmp_root, "b0", _rows(spark, 7, shift=2), steps=steps)  # a run again
    _check(spark, tmp_root)
    _run(spark, tmp_root, "b0", _rows(spark, 8))
    _check(spark, tmp_root)
    assert journal.open_records(spark, tmp_root) == []


def test_a_stopped_compaction_is_undone_or_finished(spark, tmp_root, monkeypatch):
    for seed in range(3):
        _run(spark, tmp_root, f"b{seed}", _rows(spark, seed))

    def stop(*args):
        raise RuntimeError("stopped")

    for module, name in ((journal, "switch"), (storage, "finish_run")):
        with monkeypatch.context() as m:
            m.setattr(module, name, stop)
            with pytest.raises(RuntimeError):
                deltas.compact(spark, tmp_root)
        _check(spark, tmp_root)
        assert recover(spark, tmp_root) == ["compaction"]
        _check(spark, tmp_root)
    for day, g in storage.delta_days(spark, tmp_root).items():
        assert storage.generations(spark, tmp_root, day).keys() == {g}


def test_stored_facts_of_other_keys_are_neither_shuffled_nor_summed(spark, tmp_root):
    _run(spark, tmp_root, "b0", _rows(spark, 0, n=200))
    record = journal.begin(spark, tmp_root, "b1", "deltas")
    storage.write_run_facts(_rows(spark, 1, n=2), tmp_root, record)
    run = deltas.DeltaRun(spark, None, None, tmp_root, "b1", T0, ntz(T0))
    run.record = record
    plan = run._added(storage.read_run(spark, tmp_root, record))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_an_empty_store(spark, tmp_root):
    assert deltas.read_delta_insights(spark, tmp_root).collect() == []
    assert deltas.compact(spark, tmp_root) == []

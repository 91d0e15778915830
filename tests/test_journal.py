"""Commit journal and keyed dedup state: every stop on the way, hidden runs, no state shuffle."""

import datetime as dt
import io
import contextlib
import os
import re

import pytest
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import ntz
from adperf.operators import dedup
from adperf.plans.ingest import BatchRun, ingest_batch
from adperf.plans.refresh import recover
from adperf.sources import journal, storage

SCHEMA = S.event_schema(T.LongType())
T0 = dt.datetime(2024, 1, 1, 6)
DAY = dt.timedelta(days=1)
STEPS = BatchRun.STEPS


def _rows(spark, day, keys="ab", impressions=10):
    rows = [(i, 1, "meta", "view", impressions, 0, 0, None, None, day, "EU", None, k, T0, T0)
            for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, SCHEMA)


def _insights(spark, root):
    return sorted((str(r.date), r.impressions) for r in storage.read_insights(spark, root).collect())


def _run(spark, root, batch, df, **kw):
    return ingest_batch(spark, df, root, batch, now=ntz(T0), fact_schema=SCHEMA,
                        arrived=kw.pop("arrived", T0), **kw)


@pytest.mark.parametrize("steps", range(1, len(STEPS)))
def test_a_stop_after_each_step_is_undone_or_finished(spark, tmp_root, steps):
    _run(spark, tmp_root, "b/1", _rows(spark, T0))
    _run(spark, tmp_root, "b/1", _rows(spark, T0 + 9 * DAY, impressions=7), steps=steps)
    switched = steps > STEPS.index("switch")
    # readers see one run, whole: the old one before the switch, the new one after it
    facts = {(str(r.event_time.date()), r.impressions)
             for r in storage.read_facts(spark, tmp_root).collect()}
    assert facts == ({("2024-01-10", 7)} if switched else {("2024-01-01", 10)})
    assert recover(spark, tmp_root, updated_at=ntz(T0)) == ["b_2f1"]
    assert recover(spark, tmp_root) == []
    want = [("2024-01-10", 14)] if switched else [("2024-01-01", 20)]
    assert _insights(spark, tmp_root) == want
    # the keys of the run that counts are the state: the same events again are duplicates
    again = _run(spark, tmp_root, "b2", _rows(spark, T0), arrived=T0 + DAY)
    assert (again["accepted"], again["duplicates"]) == (0, 2)
    # a further run of the batch replaces whichever of the two was left
    _run(spark, tmp_root, "b/1", _rows(spark, T0 + 3 * DAY, keys="c"))
    assert _insights(spark, tmp_root) == [("2024-01-04", 10)]
    left = [os.path.join(d, f) for d, _, names in os.walk(tmp_root) for f in names
            if f.endswith(".parquet") and "/facts/" in d]
    assert len({os.path.dirname(f) for f in left}) == 1
    assert journal.open_records(spark, tmp_root) == []


@pytest.mark.parametrize("first", range(1, len(STEPS)))
def test_a_run_that_follows_a_stopped_one_recovers_it(spark, tmp_root, first):
    _run(spark, tmp_root, "b", _rows(spark, T0 + 5 * DAY), steps=first)  # the very first run
    _run(spark, tmp_root, "b", _rows(spark, T0 + 6 * DAY), steps=first)
    _run(spark, tmp_root, "b", _rows(spark, T0))
    assert _insights(spark, tmp_root) == [("2024-01-01", 20)]
    assert storage.read_facts(spark, tmp_root).count() == 2


def test_a_second_run_of_a_batch_under_way_is_refused(spark, tmp_root):
    journal.begin(spark, tmp_root, "b")
    with pytest.raises(ValueError, match="under way"):
        journal.begin(spark, tmp_root, "b")


def test_other_batches_and_days_are_not_touched_by_recovery(spark, tmp_root):
    _run(spark, tmp_root, "b1", _rows(spark, T0, keys="ab"))
    _run(spark, tmp_root, "b2", _rows(spark, T0, keys="cd"))
    _run(spark, tmp_root, "b2", _rows(spark, T0 + DAY, keys="cd"), steps=STEPS.index("refresh"))
    recover(spark, tmp_root, "b2", ntz(T0))
    assert _insights(spark, tmp_root) == [("2024-01-01", 20), ("2024-01-02", 20)]


def test_facts_of_another_schema_are_refused(spark, tmp_root):
    storage.write_facts(_rows(spark, T0), tmp_root, "a")
    with pytest.raises(ValueError, match="facts of"):
        storage.write_facts(_rows(spark, T0).drop("currency"), tmp_root, "b")


def test_days_are_not_limited(spark, tmp_root):
    df = spark.range(3000).selectExpr(
        "id", "1L AS campaign_id", "'meta' AS platform", "timestamp_ntz'1970-01-01 00:00:00' + "
        "make_dt_interval(cast(id * 10 AS int)) AS event_time", "concat('k', id) AS deduplication_key")
    days = storage.write_facts(df.where("id < 40"), tmp_root, "b")
    assert len(days) == 40 and days[-1] == dt.date(1970, 1, 1) + dt.timedelta(390)


def test_only_the_asked_days_are_listed(spark, tmp_root):
    for n in range(4):
        storage.write_facts(_rows(spark, T0 + n * DAY), tmp_root, f"b{n}")
    df = storage.read_facts(spark, tmp_root, start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 3))
    assert {re.search(r"event_date=([-\d]+)", f)[1] for f in df.inputFiles()} == {
        "2024-01-02", "2024-01-03"}


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_a_batch_is_dealt_to_the_states_buckets_and_the_state_is_not_shuffled(spark, tmp_root):
    for n in range(3):
        _run(spark, tmp_root, f"b{n}", _rows(spark, T0, keys=[f"k{n}-{i}" for i in range(50)]),
             arrived=T0 + n * DAY)
    now = T0 + 3 * DAY
    state = storage.read_dedup_state(spark, tmp_root, now, "b9")
    assert state.count() == 150
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dedup.first_wins_arrival(
            _rows(spark, T0, keys=["k0-1", "k2-7", "new", "new"]), ntz(now), state,
            state_partitions=storage.state_buckets(spark, tmp_root))
        plan = _plan(kept.filter("deduplication_key IS NOT NULL"))
        assert {r.deduplication_key for r in kept.collect()} == {"new"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    scan = plan[plan.index("Scan parquet spark_catalog"):] if "Scan parquet spark_catalog" in plan \
        else plan
    assert "SelectedBucketsCount" in scan and "Bucketed: true" in scan
    tree = plan[:plan.index("\n\n")]
    state_side = tree[tree.index("SortMergeJoin"):].split("+- ")[-4:]
    assert not any("Exchange" in line for line in state_side), tree


def test_a_new_session_finds_the_state(spark, tmp_root):
    _run(spark, tmp_root, "b1", _rows(spark, T0))
    other = spark.newSession()
    for k, v in (("spark.sql.session.timeZone", "UTC"),):
        other.conf.set(k, v)
    spark.sql(f"DROP TABLE {storage._state_table(spark, tmp_root, 'deduplication_key')}")
    state = storage.read_dedup_state(other, tmp_root, T0 + DAY, "b2")
    assert sorted(r[0] for r in state.collect()) == ["a", "b"]
    assert storage.read_dedup_state(other, tmp_root, T0 + DAY, "b1") is None
    assert storage.read_dedup_state(other, tmp_root, T0 + 9 * DAY, "b2") is None

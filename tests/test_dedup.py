import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf.operators import dedup
from helpers import event, events_df

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def _ttl_rows(offsets, key="k"):
    return [event(id=i, key=key, received_at=T0 + off, event_time=T0 + off)
            for i, off in enumerate(offsets)]


def test_ttl_edges(spark):
    offsets = [dt.timedelta(0), 6 * DAY, 7 * DAY - dt.timedelta(microseconds=1), 7 * DAY,
               13 * DAY]
    for limit in (0, 10):
        kept = dedup.first_wins_ttl(events_df(spark, _ttl_rows(offsets)),
                                    light_limit=limit).collect()
        assert sorted(r.received_at - T0 for r in kept) == [dt.timedelta(0), 7 * DAY]


def test_skipped_duplicate_does_not_extend_ttl(spark):
    # 0d accepted, 5d skipped (would extend to 12d if it counted), 8d accepted
    kept = dedup.first_wins_ttl(events_df(spark, _ttl_rows([0 * DAY, 5 * DAY, 8 * DAY])))
    assert sorted(r.received_at - T0 for r in kept.collect()) == [0 * DAY, 8 * DAY]


def test_same_time_ties_keep_smallest_id(spark):
    rows = [event(id=5, key="k", received_at=T0), event(id=3, key="k", received_at=T0)]
    assert [r.id for r in dedup.first_wins_ttl(events_df(spark, rows)).collect()] == [3]


@pytest.mark.parametrize("limit", [0, 10])
def test_redelivered_rows_are_accepted_once(spark, limit):
    rows = [event(id=3, key="k", received_at=T0)] * 3 + [
        event(id=4, key="k", received_at=T0 + 8 * DAY)] * 2
    kept = dedup.first_wins_ttl(events_df(spark, rows), light_limit=limit).collect()
    assert sorted(r.id for r in kept) == [3, 4]


def test_arrival_ignores_event_time_and_expires_after_the_ttl(spark):
    from adperf.functions.dates import ntz
    rows = [event(id=1, key="a", received_at=T0 - 90 * DAY), event(id=2, key="b"),
            event(id=3, key="b", received_at=T0 - 91 * DAY), event(id=4, key=None)]
    state = spark.createDataFrame([("a", T0 + DAY), ("b", T0)],
                                  "deduplication_key string, accepted_at timestamp_ntz")
    kept = dedup.first_wins_arrival(events_df(spark, rows), ntz(T0 + 7 * DAY), state).collect()
    assert sorted(r.id for r in kept) == [3, 4]  # a is live; b expired, its first row wins


def test_null_ids_are_kept_by_both_paths(spark):
    rows = [event(id=None, key="k", received_at=T0), event(id=None, key="k",
                                                           received_at=T0 + 8 * DAY)]
    for limit in (0, 10):
        assert dedup.first_wins_ttl(events_df(spark, rows), light_limit=limit).count() == 2


def test_null_key_passes_through(spark):
    rows = [event(id=1, key=None), event(id=2, key=None)]
    assert dedup.first_wins_ttl(events_df(spark, rows)).count() == 2


def _brute(rows, ttl=7 * DAY):
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[12], r[13], r[0])):
        by_key.setdefault(r[12], []).append(r)
    out = set()
    for key, rs in by_key.items():
        last = None
        for r in rs:
            if last is None or r[13] >= last + ttl:
                out.add(r[0])
                last = r[13]
    return out


@pytest.mark.parametrize("seed,light_limit", [(1, 0), (2, 0), (3, 50), (4, 10_000)])
def test_ttl_matches_sequential_fold_with_hot_key(spark, seed, light_limit):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        t = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 120))
        rows.append(event(id=i, key=key, received_at=t, event_time=t))
    kept = dedup.first_wins_ttl(events_df(spark, rows), bucket_hours=6,
                                light_limit=light_limit)
    assert {r.id for r in kept.collect()} == _brute(rows)


def test_next_at_or_after_crosses_empty_buckets(spark):
    probes = spark.createDataFrame([("a", T0), ("a", T0 + 10 * DAY), ("b", T0)],
                                   "k string, p timestamp_ntz")
    targets = spark.createDataFrame([("a", T0), ("a", T0 + 30 * DAY), ("b", T0 - DAY)],
                                    "k string, t timestamp_ntz")
    got = {(r.k, r.p): r.n for r in
           dedup.next_at_or_after(probes, targets, "k", "p", "t", "n").collect()}
    assert got == {("a", T0): T0, ("a", T0 + 10 * DAY): T0 + 30 * DAY, ("b", T0): None}


def test_last_wins_by_processed_at_then_id(spark):
    rows = [event(id=1, key="k", processed_at=T0), event(id=2, key="k", processed_at=T0 + DAY),
            event(id=3, key="j", processed_at=T0), event(id=4, key="j", processed_at=T0)]
    out = dedup.last_wins(events_df(spark, rows), ["deduplication_key"],
                          ["processed_at", "id"])
    assert sorted(r.id for r in out.collect()) == [2, 4]
    assert out.columns == events_df(spark, rows).columns


def test_latest_insights_by_updated_at(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), "g", "all", 5, T0), (1, dt.date(2024, 1, 1), "g", "all", 9,
                                                       T0 + DAY)],
        T.StructType([T.StructField("campaign_id", T.LongType()),
                      T.StructField("date", T.DateType()), T.StructField("platform",
                                                                         T.StringType()),
                      T.StructField("region", T.StringType()),
                      T.StructField("clicks", T.LongType()),
                      T.StructField("updated_at", T.TimestampNTZType())]))
    assert [r.clicks for r in dedup.latest_insights(df).collect()] == [9]


@pytest.mark.parametrize("light_limit", [0, 10_000])
def test_seeds_continue_an_earlier_run(spark, light_limit):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        key = "hot" if i % 2 == 0 else f"k{rnd.randint(0, 15)}"
        t = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 60))
        rows.append(event(id=i, key=key, received_at=t, event_time=t))
    rows.sort(key=lambda r: r[13])
    first, second = rows[:200], rows[200:]
    want = _brute(rows)
    kept1 = dedup.first_wins_ttl(events_df(spark, first), light_limit=light_limit)
    got1 = {r.id: r for r in kept1.collect()}
    seeds = kept1.groupBy("deduplication_key").agg(
        F.max("received_at").alias("last_accepted"))
    kept2 = dedup.first_wins_ttl(events_df(spark, second), light_limit=light_limit,
                                 seeds=seeds)
    assert set(got1) | {r.id for r in kept2.collect()} == want

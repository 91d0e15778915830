import datetime as dt

import pytest
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import ntz
from adperf.plans import deltas
from adperf.plans.ingest import BatchRun, ingest_batch
from adperf.plans.retention import expire
from adperf.sources import storage

SCHEMA = S.event_schema(T.LongType())
T0 = dt.datetime(2024, 1, 1, 6)
DAY = dt.timedelta(days=1)


def _ingest(spark, root, batch, days, **kw):
    rows = [(i, 1, "meta", "view", 10, 0, 0, None, None, T0 + i * DAY, "EU", None, f"{batch}{i}",
             T0, T0) for i in days]
    return ingest_batch(spark, spark.createDataFrame(rows, SCHEMA), root, batch, now=ntz(T0),
                        fact_schema=SCHEMA, arrived=kw.pop("arrived", T0), **kw)


@pytest.mark.parametrize("how", [BatchRun, deltas.DeltaRun])
def test_old_days_go_whole_and_the_rest_stays(spark, tmp_root, how):
    _ingest(spark, tmp_root, "a", range(6), how=how)
    _ingest(spark, tmp_root, "b", range(3, 8), how=how, arrived=T0 + 9 * DAY)
    gone = expire(spark, tmp_root, dt.date(2024, 1, 5), arrived=T0 + 9 * DAY)
    assert gone[storage.FACTS] == [f"2024-01-0{d}" for d in range(1, 5)]
    assert gone[storage.DEDUP_STATE] == ["2024-01-01"]
    assert {str(r.event_time.date()) for r in storage.read_facts(spark, tmp_root).collect()} == {
        f"2024-01-0{d}" for d in range(5, 9)}
    read = deltas.read_delta_insights if how is deltas.DeltaRun else storage.read_insights
    assert sorted((r.date.day, r.impressions) for r in read(spark, tmp_root).collect()) == [
        (5, 20), (6, 20), (7, 10), (8, 10)]
    assert storage.read_batch(spark, tmp_root, "a").count() == 2
    assert expire(spark, tmp_root, dt.date(2024, 1, 5), arrived=T0 + 9 * DAY) == {}
    # a batch that reaches back into an expired day starts it anew
    _ingest(spark, tmp_root, "c", [0], how=how, arrived=T0 + 10 * DAY)
    assert min(r.date for r in read(spark, tmp_root).collect()) == dt.date(2024, 1, 1)


def test_a_store_with_a_run_under_way_is_left_alone(spark, tmp_root):
    _ingest(spark, tmp_root, "a", range(2), steps=3)
    with pytest.raises(ValueError, match="under way"):
        expire(spark, tmp_root, dt.date(2025, 1, 1))

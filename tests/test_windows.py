"""Windowed live insights with late rows; restarts of a failing stream."""

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import ntz
from adperf.operators import rollup
from adperf.sources import storage
from adperf.streaming import ingest, windows

SCHEMA = S.event_schema(T.LongType())
T0 = dt.datetime(2024, 1, 1, 23, 30)
DAY = dt.timedelta(days=1)


def _land(spark, folder, name, rows):
    data = [(i, 1 + i % 2, "meta", "click", 5, clicks, 0, None, None, t, "EU", None, f"k{i}", t, t)
            for i, t, clicks in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, landed, root):
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed))
    checked = ingest.prepare(stream, SCHEMA, now=ntz(T0))
    live = windows.start(checked, root, os.path.join(root, "_w"), "1 day")
    live.awaitTermination()
    until = windows.note_watermark(spark, live, root)
    dropped = sum(o.numRowsDroppedByWatermark if not isinstance(o, dict)
                  else o["numRowsDroppedByWatermark"]
                  for p in live.recentProgress for o in (
                      p["stateOperators"] if isinstance(p, dict) else p.stateOperators))
    ingest.start(checked, root, os.path.join(root, "_f"), how=windows.WindowRun).awaitTermination()
    return until, dropped


def _rows(df):
    return sorted(map(tuple, df.select(*S.INSIGHT_COLUMNS).collect()))


def _check(spark, root):
    got = _rows(windows.read_insights(spark, root))
    assert got == _rows(rollup.insights_of(storage.read_facts(spark, root)))
    return got


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_late_rows_reach_their_closed_days(spark, tmp_root, zone):
    landed, root = os.path.join(tmp_root, "in"), os.path.join(tmp_root, "store")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _land(spark, landed, "1", [(0, T0, 1), (1, T0 + DAY, 1)])
        until, dropped = _run(spark, landed, root)
        assert (until, dropped) == (dt.date(2024, 1, 1), 0)
        _check(spark, root)
        _land(spark, landed, "2", [(2, T0, 1), (3, T0 + 5 * DAY, 1)])
        until, dropped = _run(spark, landed, root)
        assert until == dt.date(2024, 1, 5)
        _check(spark, root)
        _land(spark, landed, "3", [(4, T0, 7), (5, T0 + DAY, 1), (6, T0 + 5 * DAY, 1)])
        until, dropped = _run(spark, landed, root)
        assert dropped == 2 or dropped == 3  # the window query ignored the late rows
        got = _check(spark, root)
        assert {str(r[1]) for r in got} == {"2024-01-01", "2024-01-02", "2024-01-06"}
        table = {str(r.date) for r in storage.read_insights(spark, root).collect()}
        assert table == {"2024-01-01", "2024-01-02"}  # the open day is in no table yet
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_days_closed_by_no_later_row_are_settled(spark, tmp_root):
    landed, root = os.path.join(tmp_root, "in"), os.path.join(tmp_root, "store")
    _land(spark, landed, "1", [(0, T0, 1), (1, T0 + 9 * DAY, 1)])
    _run(spark, landed, root)
    windows.settle(spark, root, ntz(T0))
    assert len(_check(spark, root)) == 2
    assert [str(r.date) for r in storage.read_insights(spark, root).collect()] == ["2024-01-01"]


def test_a_failing_stream_is_started_again_and_given_up_after_some_attempts(spark, tmp_root):
    landed, out = os.path.join(tmp_root, "in"), []
    _land(spark, landed, "1", [(0, T0, 1)])
    left, waits = [2], []

    def begin():
        def write(df, epoch):
            if left[0]:
                left[0] -= 1
                raise RuntimeError("store away")
            out.extend(r.id for r in df.collect())

        return (spark.readStream.schema(SCHEMA).parquet(landed).writeStream.foreachBatch(write)
                .option("checkpointLocation", os.path.join(tmp_root, "ck"))
                .trigger(availableNow=True).start())

    ingest.keep_running(begin, sleep=waits.append)
    assert out == [0] and waits == [1.0, 2.0]
    left[0] = 99
    _land(spark, landed, "2", [(1, T0, 1)])
    with pytest.raises(StreamingQueryException):
        ingest.keep_running(begin, attempts=3, sleep=waits.append)
    assert left[0] == 96

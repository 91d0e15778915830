"""Message log: offsets, gaps, redelivery, resume; the writer's failed and replayed epochs."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from adperf.sources import events as ev
from adperf.sources import message_log as M


def _segment(log, partition, first, values, name="x"):
    folder = os.path.join(log, f"partition={partition}")
    os.makedirs(folder, exist_ok=True)
    table = pa.table({"key": [f"k{partition}"] * len(values), "value": values}, schema=M.SEGMENT)
    end = first + len(values)
    pq.write_table(table, f"{folder}/{first:020d}-{end:020d}-{name}.parquet")


def _read(spark, log):
    rows = spark.read.format(M.register(spark)).load(log).collect()
    return sorted((r.partition, r.offset, r.value) for r in rows)


def _consume(spark, log, checkpoint, **options):
    """Values that one start of a consumer takes, until nothing more is available."""
    got = []
    stream = ev.event_stream(spark, M.FORMAT, log, options)
    query = (stream.writeStream.foreachBatch(lambda df, _: got.extend(
        r.value for r in df.collect())).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return sorted(got)


def test_overlaps_are_read_once_and_gaps_are_waited_for(spark, tmp_root):
    log = os.path.join(tmp_root, "log")
    _segment(log, 0, 0, ["a", "b", "c"])
    _segment(log, 0, 0, ["a", "b"], "again")
    _segment(log, 0, 2, ["c", "d"], "overlap")
    _segment(log, 0, 6, ["g"])  # e and f have not arrived
    _segment(log, 3, 5, ["z"])  # an older part of this partition was deleted
    assert _read(spark, log) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (0, 3, "d"), (3, 5, "z")]
    _segment(log, 0, 4, ["e", "f"], "late")
    assert [r[2] for r in _read(spark, log)] == ["a", "b", "c", "d", "e", "f", "g", "z"]


def test_a_consumer_resumes_after_the_last_message(spark, tmp_root):
    log, ck = os.path.join(tmp_root, "log"), os.path.join(tmp_root, "ck")
    _segment(log, 0, 0, ["a", "b", "c"])
    assert _consume(spark, log, ck, maxOffsetsPerTrigger="2") == ["a", "b"]
    M.redeliver(log)
    _segment(log, 1, 0, ["p"])  # a new partition
    assert _consume(spark, log, ck) == ["c", "p"]
    assert _consume(spark, log, ck) == []
    _segment(log, 0, 3, ["d"])
    assert _consume(spark, log, ck) == ["d"]


@pytest.mark.parametrize("start, want", [
    ("earliest", ["a", "b", "p", "q"]), ("latest", []), ('{"0": 1, "1": 5}', ["b"])])
def test_starting_offsets(spark, tmp_root, start, want):
    log = os.path.join(tmp_root, "log")
    _segment(log, 0, 0, ["a", "b"])
    _segment(log, 1, 3, ["p", "q"])
    assert _consume(spark, log, os.path.join(tmp_root, "ck"), startingOffsets=start) == want


def test_a_lost_segment_is_an_error_not_a_silent_skip(spark, tmp_root):
    log = os.path.join(tmp_root, "log")
    _segment(log, 0, 4, ["e"])
    with pytest.raises(ValueError, match="no segment for offset 2"):
        M.slices(log, {"0": 2}, {"0": 5})


def _batch(values):
    return iter([pa.RecordBatch.from_pydict({"key": [v[0] for v in values], "value": values})])


def test_failed_epochs_leave_nothing_and_replayed_ones_no_second_copy(tmp_root):
    log = os.path.join(tmp_root, "log")
    writer = M.LogStreamWriter({"path": log, "logPartitions": "2"})
    first = writer.write(_batch(["a1", "b1"]))
    writer.abort([first, None], 0)  # a task of the epoch failed
    assert M.segments(log) == {} and os.listdir(f"{log}/_staged") == []
    writer.commit([writer.write(_batch(["a1", "b1"])), None], 0)
    writer.commit([writer.write(_batch(["a1", "b1"]))], 0)  # the epoch is replayed
    writer.abort([writer.write(_batch(["a1"]))], 0)
    writer.commit([writer.write(_batch(["a2"])), writer.write(_batch(["a3", "c1"]))], 1)
    values = [v for parts in M.segments(log).values() for f in parts
              for v in pq.read_table(f[2])["value"].to_pylist()]
    assert sorted(values) == ["a1", "a2", "a3", "b1", "c1"] and os.listdir(f"{log}/_staged") == []
    for parts in M.segments(log).values():
        assert parts[0][0] == 0 and M.reach(parts, 0) == parts[-1][1]


def test_a_commit_that_stops_between_renames_is_finished_by_its_replay(tmp_root, monkeypatch):
    log = os.path.join(tmp_root, "log")
    writer = M.LogStreamWriter({"path": log, "logPartitions": "8"})
    staged = writer.write(_batch([f"{c}1" for c in "abcdefgh"]))
    real, moved = M._open(log)[0], []

    class Stops:
        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, a, b):
            if "partition=" in b:
                moved.append(b)
                if len(moved) == 2:
                    raise OSError("driver lost")
            real.move(a, b)

    with monkeypatch.context() as m:
        m.setattr(M, "_open", lambda path: (Stops(), path))
        with pytest.raises(OSError):
            writer.commit([staged], 4)
    assert len(M.segments(log)) == 1
    writer.commit([writer.write(_batch([f"{c}1" for c in "abcdefgh"]))], 4)
    values = [v for parts in M.segments(log).values() for f in parts
              for v in pq.read_table(f[2])["value"].to_pylist()]
    assert sorted(values) == [f"{c}1" for c in "abcdefgh"]


def test_a_stream_that_fails_and_restarts_writes_every_message_once(spark, tmp_root):
    source, log = os.path.join(tmp_root, "in"), os.path.join(tmp_root, "log")
    spark.range(30).selectExpr("cast(id % 5 AS string) AS key", "concat('v', id) AS value") \
        .repartition(3).write.parquet(source)
    flag = os.path.join(tmp_root, "broken")
    open(flag, "w").close()

    def run():
        stream = (spark.readStream.schema("key string, value string")
                  .option("maxFilesPerTrigger", 1).parquet(source))

        @F.udf("string")
        def checked(value):
            if value == "v17" and os.path.exists(flag):
                raise RuntimeError("task failed")
            return value

        return ev.publish(stream.withColumn("value", checked("value")), M.FORMAT, path=log,
                          checkpoint=os.path.join(tmp_root, "ck"), available_now=True)

    with pytest.raises(Exception, match="task failed"):
        run().awaitTermination()
    before = {v for _, _, v in _read(spark, log)} if M.segments(log) else set()
    assert "v17" not in before
    os.remove(flag)
    run().awaitTermination()
    assert sorted(v for _, _, v in _read(spark, log)) == sorted(f"v{i}" for i in range(30))

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.catalog import land
from adperf.functions.dates import ntz
from adperf.operators import rollup
from adperf.plans.ingest import ingest_batch
from adperf.plans.reaggregate import reaggregate_stored
from adperf.sources import journal, storage
from adperf.streaming import ingest

SCHEMA = S.event_schema(T.LongType())
DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1, 6)


def _msg(i, key, t, clicks=1, platform="google"):
    return json.dumps({"id": i, "campaign_id": 1 + i % 3, "platform": platform,
                       "event_type": "click", "impressions": 5, "clicks": clicks,
                       "spend": 0.5, "revenue": 1.0, "event_time": t.isoformat(),
                       "region": "EU", "deduplication_key": key,
                       "received_at": t.isoformat()})


FILE1 = [_msg(1, "a", T0), _msg(2, "b", T0), _msg(3, "a", T0 + 3 * DAY), "{broken",
         _msg(4, "c", T0, platform="")]
FILE2 = [_msg(5, "a", T0 - 18 * DAY), _msg(6, "b", T0 + 2 * DAY), _msg(7, "d", T0 - 40 * DAY)]
# judged by arrival: 3 repeats a; in the second file 5 and 6 come within the TTL of 1 and 2 when
# it arrives a day later, and are accepted when it arrives eight days later, however late they are
WITHIN, EXPIRED = {1, 2, 7}, {1, 2, 5, 6, 7}


def _land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def _run_stream(spark, landing, root, days=1):
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(landing)
    prepared = ingest.prepare(stream, SCHEMA, now=ntz(T0))
    q = ingest.start(prepared, root, os.path.join(root, "_ck"),
                     arrived=lambda epoch: T0 + epoch * days * DAY)
    q.awaitTermination()


def _fact_ids(spark, root):
    return {r.id for r in storage.read_facts(spark, root).collect()}


@pytest.mark.parametrize("days,expected", [(1, WITHIN), (8, EXPIRED)])
def test_stream_equals_batches_and_survives_restart(spark, tmp_root, days, expected):
    landing, root = os.path.join(tmp_root, "in"), os.path.join(tmp_root, "store")
    _land(landing, "1.txt", FILE1)
    _run_stream(spark, landing, root, days)
    assert _fact_ids(spark, root) == {1, 2}
    _land(landing, "2.txt", FILE2)           # restart from the checkpoint with a new file
    _run_stream(spark, landing, root, days)
    assert _fact_ids(spark, root) == expected
    _run_stream(spark, landing, root, days)  # replay: nothing new
    assert _fact_ids(spark, root) == expected
    rejects = spark.read.parquet(os.path.join(root, storage.REJECTS))
    assert sorted(r.reject_reason for r in rejects.collect()) == ["malformed JSON",
                                                                   "missing platform"]
    # the batch path over the same messages gives the same facts and insights
    broot = os.path.join(tmp_root, "batch")
    counts = []
    for n, part in enumerate((FILE1, FILE2)):
        msgs = spark.createDataFrame([(m,) for m in part], "value string")
        counts.append(ingest_batch(spark, msgs, broot, f"b{n}", now=ntz(T0), fact_schema=SCHEMA,
                                   arrived=T0 + n * days * DAY))
    assert counts[0] == {"accepted": 2, "duplicates": 1, "rejected": 2}
    assert counts[1]["accepted"] == len(expected) - 2
    assert _fact_ids(spark, broot) == expected
    cols = list(S.INSIGHT_COLUMNS)
    s_ins = sorted(map(tuple, storage.read_insights(spark, root).select(cols).collect()))
    b_ins = sorted(map(tuple, storage.read_insights(spark, broot).select(cols).collect()))
    assert s_ins == b_ins


def test_redelivered_rows_count_once(spark, tmp_root):
    msgs = spark.createDataFrame([(_msg(1, "a", T0),)] * 3, "value string")
    counts = ingest_batch(spark, msgs, tmp_root, "b1", now=ntz(T0), fact_schema=SCHEMA)
    assert counts == {"accepted": 1, "duplicates": 2, "rejected": 0}
    again = ingest_batch(spark, msgs, tmp_root, "b2", now=ntz(T0), fact_schema=SCHEMA)
    assert again["accepted"] == 0
    assert storage.read_insights(spark, tmp_root).first().impressions == 5


def test_rerun_replaces_other_days_and_an_empty_rerun_empties(spark, tmp_root):
    def batch(day):
        rows = [(1, 1, "meta", "view", 10, 0, 0, None, None, day, "EU", None, "k", T0, T0)]
        return spark.createDataFrame(rows, SCHEMA)

    ingest_batch(spark, batch(T0), tmp_root, "b1", now=ntz(T0))
    ingest_batch(spark, batch(T0 + DAY), tmp_root, "b1", now=ntz(T0))
    assert [r.date for r in storage.read_insights(spark, tmp_root).collect()] == [
        (T0 + DAY).date()]
    assert storage.read_facts(spark, tmp_root).count() == 1
    ingest_batch(spark, batch(T0).limit(0), tmp_root, "b1", now=ntz(T0))
    assert storage.read_facts(spark, tmp_root).count() == 0
    assert storage.read_insights(spark, tmp_root).count() == 0


def test_rerun_on_a_later_day_replaces_its_dedup_state(spark, tmp_root):
    def run(name, keys, day, **kw):
        rows = [(i, 1, "meta", "view", 10, 0, 0, None, None, T0, "EU", None, k, T0, T0)
                for i, k in enumerate(keys)]
        return ingest_batch(spark, spark.createDataFrame(rows, SCHEMA), tmp_root, name,
                            now=ntz(T0), fact_schema=SCHEMA, arrived=T0 + day * DAY,
                            **kw)["accepted"]

    for name in ("007", "1e3", "b é/1"):  # ids that partition columns could misread
        keys = [f"{name}-{k}" for k in "abc"]
        assert run(name, keys, 0) == 3
        assert run(name, keys, 1) == 3        # sees nothing of its first run
        assert run(name, keys[:1], 1) == 1
        assert run(f"{name}+", keys, 2) == 2  # what the re-run lost is accepted, the rest not
        assert run(f"{name}+", [], 3) == 0
        assert run(name, keys[:1], 3, mode="last") == 1  # keeps no state
        assert run(f"{name}++", keys, 4) == 3


def test_insights_range_prunes_day_partitions(spark, tmp_root):
    rows = [(i, 1, "meta", "view", 10, 0, 0, None, None, T0 + i * DAY, "EU", None, f"k{i}", T0, T0)
            for i in range(5)]
    ingest_batch(spark, spark.createDataFrame(rows, SCHEMA), tmp_root, "b", now=ntz(T0))
    asked = storage.read_insights(spark, tmp_root, dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert asked.count() == 2
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day" in plan.split("PartitionFilters")[1]


def test_ensure_tables_creates_schemas(spark, tmp_root):
    names = storage.ensure_tables(spark, tmp_root, database="adperf_new")
    assert names == storage.ensure_tables(spark, tmp_root, database="adperf_new")
    facts = spark.table("adperf_new.facts")
    assert set(S.EVENT_SCHEMA.fieldNames()) | {"ingest_batch", "event_date", "run"} == set(
        facts.columns)
    assert facts.isEmpty() and spark.table("adperf_new.insights").isEmpty()


def test_batch_rerun_is_idempotent_and_reaggregation(spark, tmp_root):
    rows = [(i, 1, "meta", "view", 10, 0, 0, None, None, T0 + (i % 5) * DAY, "EU", None,
             f"k{i}", T0, T0) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    now = ntz(T0)
    ingest_batch(spark, df, tmp_root, 1, now=now)
    ingest_batch(spark, df, tmp_root, 1, now=now)
    assert storage.read_facts(spark, tmp_root).count() == 10
    before = sorted(map(tuple, storage.read_insights(spark, tmp_root)
                        .select(*S.INSIGHT_COLUMNS).collect()))
    reaggregate_stored(spark, tmp_root, "2024-01-02", "2024-01-03")
    after = sorted(map(tuple, storage.read_insights(spark, tmp_root)
                       .select(*S.INSIGHT_COLUMNS).collect()))
    assert before == after and len(after) == 5
    names = storage.register_tables(spark, tmp_root, "adperf_test")
    assert "adperf_test.insights" in names
    assert spark.sql("SELECT count(*) FROM adperf_test.facts WHERE event_date >= "
                     "DATE'2024-01-02' AND event_date <= DATE'2024-01-03'").first()[0] == 4
    facts = storage.read_facts(spark, tmp_root, start=dt.date(2024, 1, 2),
                               end=dt.date(2024, 1, 3))
    assert facts.count() == 4
    assert rollup.daily_insights(facts).count() == 2


def test_publish_batch_to_files(spark, tmp_root):
    from adperf.sources import events as ev
    df = spark.createDataFrame([(1, 2, "meta")], "id long, campaign_id long, platform string")
    path = os.path.join(tmp_root, "out")
    ev.publish(df, fmt="json", path=path)
    back = spark.read.json(path).first()
    assert back.key == "2" and json.loads(back.value)["platform"] == "meta"


def test_batch_ingest_last_mode_keeps_corrections(spark, tmp_root):
    rows = [(1, 1, "meta", "daily_stats", 10, 1, 0, None, None, T0, "all", None, "meta:1:d",
             T0, T0),
            (2, 1, "meta", "daily_stats", 15, 2, 0, None, None, T0, "all", None, "meta:1:d",
             T0 + DAY, T0 + DAY)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = ingest_batch(spark, df, tmp_root, 1, now=ntz(T0), processed_at=F.col("processed_at"),
                          mode="last")
    assert counts["accepted"] == 1 and counts["duplicates"] == 1
    ins = storage.read_insights(spark, tmp_root).first()
    assert (ins.impressions, ins.clicks) == (15, 2)


def test_event_stream_source_and_streaming_publish(spark, tmp_root):
    from adperf.sources import events as ev
    landing = os.path.join(tmp_root, "in")
    _land(landing, "1.txt", FILE1)
    _land(landing, "2.txt", FILE2)
    stream = ev.event_stream(spark, fmt="text", path=landing)
    assert stream.columns == ["key", "value"] and stream.isStreaming
    root = os.path.join(tmp_root, "store")
    q = ingest.run(stream, root, os.path.join(root, "_ck"), fact_schema=SCHEMA, now=ntz(T0))
    q.awaitTermination()
    assert len(_fact_ids(spark, root)) == 3  # one row for each of a, b, d
    # republish the landed messages as a keyed stream of JSON files
    decoded = ev.decoded_ok(ev.decode_events(ev.event_stream(spark, fmt="text", path=landing),
                                             SCHEMA)).drop("key")
    out = os.path.join(tmp_root, "out")
    pq = ev.publish(decoded, fmt="json", path=out, checkpoint=os.path.join(tmp_root, "pub_ck"))
    pq.processAllAvailable()
    pq.stop()
    assert spark.read.json(out).count() == len(FILE1) + len(FILE2) - 1  # the broken message


def test_rejects_are_written_by_the_tasks_that_hold_them(spark, tmp_root):
    record = journal.begin(spark, tmp_root, "b1")
    bad = spark.range(0, 100, 1, 4).withColumn("reject_reason", F.lit("x"))
    storage.write_run_rejects(bad, tmp_root, record)
    path = os.path.join(tmp_root, "rejects", "ingest_batch=b1", f"run={record.run}")
    assert len(journal.children(spark, path)) == 4  # one task wrote all of them before
    assert spark.read.parquet(path).count() == 100


def test_a_delivery_of_many_files_is_one_micro_batch(spark, tmp_root):
    landed, seen = os.path.join(tmp_root, "in"), []
    for n, rows in enumerate((1000, 2, 0, 500)):
        land(spark.range(rows).toDF("id"), landed, 4)
        assert len(journal.children(spark, landed)) == 4 * (n + 1)
    stream = (spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(landed))
    stream.writeStream.foreachBatch(lambda df, epoch: seen.append(df.count())).option(
        "checkpointLocation", os.path.join(tmp_root, "ck")).trigger(
        availableNow=True).start().awaitTermination()
    assert [n for n in seen if n] == [1000, 2, 500]

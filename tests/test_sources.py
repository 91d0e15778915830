import datetime as dt
import json
import os
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.sources import events as ev
from adperf.sources import payloads

SCHEMA = S.event_schema(T.LongType())


def _decode(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return ev.decode_events(df, SCHEMA).collect()


def test_decode_strict(spark):
    good = json.dumps({"id": 1, "campaign_id": 2, "platform": "meta", "impressions": 3,
                       "spend": 1.25, "event_time": "2024-01-02T03:04:05.123456789Z",
                       "deduplication_key": "k", "extra": "ignored"})
    rows = _decode(spark, [good, '{"id": 1, "impressions": ', '{"id": 1, "impressions": 1.5}',
                           "null", None])
    assert rows[0].decode_error is None
    assert rows[0].event_time == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    assert rows[0].spend == Decimal("1.25") and rows[0].impressions == 3
    assert rows[1].decode_error == "malformed JSON"
    assert rows[2].decode_error == "malformed JSON" and rows[2].id is None
    assert rows[3].decode_error is not None
    assert rows[4].decode_error == "empty message"


def test_encode_decode_roundtrip(spark):
    df = spark.createDataFrame(
        [(7, 8, "google", "view", 1, 2, 3, Decimal("4.50"), Decimal("0.00"),
          dt.datetime(2024, 1, 1, 0, 0, 7, 179575), "all", "USD", "k",
          dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))], SCHEMA)
    wire = ev.encode_events(df)
    assert wire.first().key == "8"
    back = ev.decoded_ok(ev.decode_events(wire, SCHEMA)).drop("key")
    assert back.collect() == df.collect()


def test_payload_files_flatten_and_route(spark, tmp_root):
    pages = {
        ("meta", "ext-1"): [{"date_start": "2024-01-01", "date_stop": "2024-01-01",
                              "impressions": 10, "clicks": 2, "actions": 1, "spend": 3.5,
                              "action_values": 7.0},
                             {"date_start": "2024-01-02", "date_stop": "2024-01-02",
                              "impressions": 20, "clicks": 4, "actions": 0, "spend": 1.0,
                              "action_values": 0.0}],
        ("meta", "ext-2"): [{"date_start": "01/03/2024", "impressions": 1}],
        ("bing", "ext-1"): [{"date_start": "2024-01-01", "impressions": 1}],
    }
    for i, ((platform, ext), data) in enumerate(pages.items()):
        folder = os.path.join(tmp_root, f"platform={platform}", f"external_id={ext}")
        os.makedirs(folder)
        with open(os.path.join(folder, f"page-{i}.json"), "w") as fh:
            json.dump({"data": data, "paging": {"cursors": {"before": "a", "after": "b"}}}, fh)
    flat = payloads.flatten_payloads(payloads.read_payloads(spark, tmp_root))
    assert flat.count() == 4
    camps = spark.createDataFrame([(100, "meta", "ext-1"), (200, "meta", "ext-2")],
                                  "id long, platform string, external_id string")
    good, bad = payloads.route_to_campaigns(flat, camps)
    rows = sorted(good.collect(), key=lambda r: r.event_time or dt.datetime.min)
    assert [r.campaign_id for r in rows] == [200, 100, 100]
    r = rows[1]
    assert (r.conversions, r.revenue, r.deduplication_key, r.event_type) == \
        (1, Decimal("7.00"), "meta:ext-1:2024-01-01", "daily_stats")
    assert rows[0].event_time is None  # bad date -> rejected later by validation
    assert [r.reason for r in bad.collect()] == ["unknown platform"]
    again, _ = payloads.route_to_campaigns(flat, camps)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in good.collect())


def test_pack_is_inverse_of_flatten(spark):
    daily = spark.createDataFrame(
        [("meta", "e1", dt.date(2024, 1, 1), 1, 2, 3, 4.25, 5.0),
         ("meta", "e1", dt.date(2024, 1, 2), 1, 2, 3, 4.25, 5.0)],
        "platform string, external_id string, date date, impressions long, clicks long, "
        "conversions long, spend double, revenue double")
    pages = payloads.pack_payloads(daily)
    assert pages.count() == 1
    flat = payloads.flatten_payloads(pages)
    assert flat.agg(F.sum("spend")).first()[0] == Decimal("8.50")


def test_adapter_registry_and_dimensions(spark, tmp_root):
    from adperf.sources import dimensions
    pages = spark.createDataFrame(
        [("meta", "e1", [("2024-01-01", "2024-01-01", 1, 2, 3, 4.0, 5.0)]),
         ("bing", "e1", [("2024-01-01", "2024-01-01", 1, 2, 3, 4.0, 5.0)])],
        "platform string, external_id string, data array<struct<date_start:string, "
        "date_stop:string, impressions:long, clicks:long, actions:long, spend:double, "
        "action_values:double>>")
    flat = payloads.adapt_pages(pages)
    assert sorted(r.platform for r in flat.collect()) == ["bing", "meta"]
    users = spark.createDataFrame([("u1", "a@x", "A", "secret", "admin")],
                                  "id string, email string, name string, password string, "
                                  "role string")
    path = os.path.join(tmp_root, "users")
    users.write.parquet(path)
    loaded = dimensions.read_users(spark, path)
    assert "password" not in loaded.columns and loaded.first().email == "a@x"

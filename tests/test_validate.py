from decimal import Decimal

from pyspark.sql import functions as F

from adperf.functions.dates import ntz
from adperf.operators import validate
from helpers import event, events_df, ts


def _run(spark, rows):
    df = events_df(spark, rows)
    return {r.id: r for r in validate.validate(df, now=ntz(ts(30)))
            .collect()}


def test_first_failure_in_order(spark):
    rows = [event(id=1, campaign_id=None), event(id=2, platform=None),
            event(id=3, platform=""), event(id=4, event_time=None, received_at=ts(1)),
            event(id=5, key=""), event(id=6, key=None),
            event(id=7, campaign_id=None, platform=None),   # two missing: first wins
            event(id=8, platform=None, key=None), event(id=9)]
    out = _run(spark, rows)
    assert out[1].reject_reason == "missing campaign ID"
    assert out[2].reject_reason == "missing platform"
    assert out[3].reject_reason == "missing platform"
    assert out[4].reject_reason == "missing event time"
    assert out[5].reject_reason == "missing deduplication key"
    assert out[6].reject_reason == "missing deduplication key"
    assert out[7].reject_reason == "missing campaign ID"
    assert out[8].reject_reason == "missing platform"
    assert out[9].reject_reason is None


def test_negative_metrics_clamped_and_null_is_zero(spark):
    rows = [event(id=1, impressions=-5, clicks=-1, conversions=-2, spend="-3.50",
                  revenue="-1.00"),
            event(id=2, impressions=None, spend=None)]
    out = _run(spark, rows)
    r = out[1]
    assert (r.impressions, r.clicks, r.conversions) == (0, 0, 0)
    assert (r.spend, r.revenue) == (Decimal("0.00"), Decimal("0.00"))
    assert out[2].impressions == 0 and out[2].spend == Decimal("0.00")


def test_defaults_for_empty_and_null(spark):
    rows = [event(id=1, event_type="", region="", currency=""),
            event(id=2, event_type=None, region=None, currency=None)]
    for r in _run(spark, rows).values():
        assert (r.event_type, r.region, r.currency) == ("stats", "all", "USD")


def test_missing_id_gets_deterministic_default(spark):
    rows = [event(id=None, key="a"), event(id=None, key="b")]
    df = events_df(spark, rows)
    a = sorted(r.id for r in validate.validate(df).collect())
    b = sorted(r.id for r in validate.validate(df).collect())
    assert a == b and None not in a and a[0] != a[1]


def test_received_at_default_and_processed_stamp(spark):
    df = events_df(spark, [event(id=1)]).withColumn("received_at", F.lit(None)
                                                    .cast("timestamp_ntz"))
    now = ntz(ts(30))
    r = validate.validate(df, now=now).first()
    assert r.received_at == ts(30) and r.processed_at == ts(30)


def test_split_counts_add_up(spark):
    rows = [event(id=i, platform=None if i % 3 == 0 else "meta") for i in range(30)]
    checked = validate.validate(events_df(spark, rows))
    assert validate.accepted(checked).count() + validate.rejected(checked).count() == 30

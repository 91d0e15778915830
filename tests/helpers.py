"""Small frame builders for unit tests."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from adperf import schemas as S

LONG_EVENT = S.event_schema(T.LongType())


def ts(day, *hms, micro=0):
    return dt.datetime(2024, 1, day, *hms, microsecond=micro)


_DEFAULT = object()


def event(id=1, campaign_id=10, platform="google", event_type="view", impressions=10,
          clicks=1, conversions=0, spend="1.00", revenue="0.00", event_time=_DEFAULT,
          region="EU", currency="USD", key="k", received_at=None, processed_at=None):
    et = ts(1, 12) if event_time is _DEFAULT else event_time
    return (id, campaign_id, platform, event_type, impressions, clicks, conversions,
            None if spend is None else Decimal(spend),
            None if revenue is None else Decimal(revenue), et, region, currency, key,
            received_at or et, processed_at or et)


def events_df(spark, rows, schema=LONG_EVENT):
    return spark.createDataFrame(rows, schema)

"""The insights request over the stored table: J1 -> F1/F2 -> A7 -> O1 on S6."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.functions.dates import default_range
from adperf.operators import insights
from adperf.sources import storage


def insights_request(spark: SparkSession, root: str, requests: DataFrame, campaigns: DataFrame,
                     as_of: dt.date, start=None, end=None, platform: str | None = None,
                     region: str | None = None, granularity: str | None = "daily") -> DataFrame:
    """Answer a batch of ``(user_id, campaign_id)`` requests from the stored insights.

    The range (default: the last 30 days) prunes the table's day partitions. Every request
    comes back: ``access`` is ``ok``, ``forbidden`` or ``not_found``, and only ``ok`` ones have
    insight rows, numbered from 1 in O1's order (``position``; null without a row).
    """
    s, e = default_range(start, end, as_of)
    stored = storage.read_insights(spark, root, s, e)
    asked = insights.authorized_requests(
        requests.select("user_id", "campaign_id").distinct(), campaigns)
    found = insights.owner_insights(stored, campaigns, requests, s, e, platform, region,
                                    granularity, ordered=False)
    order = Window.partitionBy("user_id", "campaign_id").orderBy(
        *[k for k in ("date",) + S.INSIGHT_KEY[2:]])
    found = found.withColumn("position", F.row_number().over(order))
    return asked.join(found, ["user_id", "campaign_id"], "left")

"""Fetch-window planning (T5): which (campaign, day) pairs to pull from each platform.

Per campaign the window runs from ``max(as_of - 30 days, start_date)`` to ``as_of``, one row
per day with both ends included; a campaign starting after ``as_of`` has no rows, and
``end_date`` is not used. The day spine is ``explode(sequence(...))`` - at most 31 rows per
campaign, so no row fans out beyond a fixed bound. Days already stored are removed with an
anti join, which is how a re-run only asks for what is missing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.operators.insights import authorized_requests


def fetch_plan(campaigns: DataFrame, as_of: dt.date,
               lookback_days: int = S.FETCH_LOOKBACK_DAYS, id_col: str = "id") -> DataFrame:
    """``(campaign_id, platform, day)`` rows to fetch."""
    end = F.lit(as_of)
    start = F.greatest(F.date_sub(end, lookback_days), F.to_date(F.col("start_date")))
    return (campaigns
            .select(F.col(id_col).alias("campaign_id"), "platform", start.alias("_s"))
            .filter(F.col("_s") <= end)
            .select("campaign_id", "platform",
                    F.explode(F.sequence(F.col("_s"), end, F.expr("INTERVAL 1 DAY")))
                    .alias("day")))


def owned_fetch_plan(requests: DataFrame, campaigns: DataFrame, as_of: dt.date,
                     lookback_days: int = S.FETCH_LOOKBACK_DAYS) -> DataFrame:
    """T5 + J1: the plan of every ``(user_id, campaign_id)`` request, with ``access``.

    A request for a campaign of another user (``forbidden``) or for none (``not_found``) is
    answered by one row without platform and day; one for a campaign that starts after
    ``as_of`` has no row.
    """
    judged = authorized_requests(requests.select("user_id", "campaign_id").distinct(), campaigns)
    plan = fetch_plan(campaigns, as_of, lookback_days)
    allowed = judged.filter(F.col("access") == "ok").join(plan, "campaign_id")
    refused = judged.filter(F.col("access") != "ok")
    return allowed.unionByName(refused, allowMissingColumns=True)


def missing_days(plan: DataFrame, stored: DataFrame, day_col: str = "date") -> DataFrame:
    """Planned ``(campaign_id, day)`` pairs with no stored row yet."""
    have = stored.select("campaign_id", F.col(day_col).alias("day")).distinct()
    return plan.join(have, ["campaign_id", "day"], "left_anti")

"""Insight queries: filters (F1), default range (F2), owner scope (J1), order (O1).

The filter is one conjunction of the requested predicates, so Catalyst pushes it to the
Parquet scan of a stored insight table (and prunes month partitions when the table is
partitioned by ``month``). The owner scope is a semi join against the campaign dimension;
the dimension side is a filtered, projected key set, and AQE picks broadcast or shuffle from
its measured size.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.functions.dates import check_granularity, default_range, parse_day
from adperf.operators.rollup import regroup_insights, regroup_insights_by


def insight_predicate(campaign_id=None, start: dt.date | str | None = None,
                      end: dt.date | str | None = None, platform: str | None = None,
                      region: str | None = None) -> Column:
    """AND of the given predicates; an empty region is ignored."""
    preds: list[Column] = [F.lit(True)]
    if campaign_id is not None:
        preds.append(F.col("campaign_id") == F.lit(campaign_id))
    s, e = parse_day(start, "start_date"), parse_day(end, "end_date")
    if s is not None:
        preds.append(F.col("date") >= F.lit(s))
    if e is not None:
        preds.append(F.col("date") <= F.lit(e))
    if platform is not None:
        preds.append(F.col("platform") == F.lit(platform))
    if region:
        preds.append(F.col("region") == F.lit(region))
    return reduce(lambda a, b: a & b, preds)


def query_insights(insights: DataFrame, campaign_id=None, start=None, end=None,
                   platform: str | None = None, region: str | None = None,
                   granularity: str | None = "daily", as_of: dt.date | None = None,
                   ordered: bool = True) -> DataFrame:
    """F1 + F2 + A7 + O1 over a daily insight table.

    When ``as_of`` is given, a missing start / end defaults to ``as_of - 30 days`` /
    ``as_of`` (both whole days, both included).
    """
    g = check_granularity(granularity)
    if as_of is not None:
        start, end = default_range(start, end, as_of)
    pred = insight_predicate(campaign_id, start, end, platform, region)
    out = regroup_insights(insights.filter(pred), g)
    return out.orderBy("date", *[k for k in S.INSIGHT_KEY if k != "date"]) if ordered else out


def authorized_requests(requests: DataFrame, campaigns: DataFrame) -> DataFrame:
    """J1 access check of ``(user_id, campaign_id)`` requests.

    Adds ``access``: ``ok``, ``forbidden`` (campaign of another user) or ``not_found``.
    """
    owners = campaigns.select(F.col("id").alias("campaign_id"),
                              F.col("user_id").alias("_owner"))
    return (requests.join(owners, "campaign_id", "left")
            .withColumn("access", F.when(F.col("_owner").isNull(), F.lit("not_found"))
                        .when(F.col("_owner") == F.col("user_id"), F.lit("ok"))
                        .otherwise(F.lit("forbidden")))
            .drop("_owner"))


def insights_for_users(insights: DataFrame, owners: DataFrame, users: DataFrame) -> DataFrame:
    """J1 as a set operation: the insights of every campaign owned by one of ``users``.

    ``owners`` is ``(campaign_id, user_id)``; ``users`` is ``(user_id)``. Rows of campaigns
    without an owner, or owned by someone else, are never returned.
    """
    allowed = owners.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return insights.join(allowed.select("campaign_id", "user_id"), "campaign_id")


def owner_insights(insights: DataFrame, campaigns: DataFrame, requests: DataFrame,
                   start=None, end=None, platform: str | None = None,
                   region: str | None = None, granularity: str | None = "daily",
                   as_of: dt.date | None = None, ordered: bool = True) -> DataFrame:
    """The insights request end to end, for a batch of ``(user_id, campaign_id)`` requests:
    J1 (only campaigns that exist and belong to the requesting user) -> F1 / F2 filters ->
    A7 granularity -> O1 order. Output: the request's ``user_id`` plus the insight columns."""
    ok = (authorized_requests(requests.select("user_id", "campaign_id").distinct(), campaigns)
          .filter(F.col("access") == "ok").select("campaign_id", "user_id"))
    scoped = insights.join(ok, "campaign_id")
    g = check_granularity(granularity)
    if as_of is not None:
        start, end = default_range(start, end, as_of)
    filtered = scoped.filter(insight_predicate(None, start, end, platform, region))
    out = regroup_insights_by(filtered, g, ["user_id"])
    return out.orderBy("user_id", "date", *[k for k in S.INSIGHT_KEY if k != "date"]) \
        if ordered else out

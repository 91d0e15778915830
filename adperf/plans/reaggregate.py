"""Re-aggregation job (A9) over the stored tables.

Reads the facts of ``start..end`` (day partitions pruned), keeps the last version per fact key,
recomputes the daily insights of the selected campaigns and replaces all their rows of those
days. Running it twice gives the same table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.functions.dates import default_range, parse_day
from adperf.operators import insights, rollup
from adperf.plans.refresh import refresh_days
from adperf.session import checkpoint_dir
from adperf.sources import storage


def _days(start: dt.date, end: dt.date) -> list[dt.date]:
    return [start + dt.timedelta(days=n) for n in range((end - start).days + 1)]


def reaggregate_stored(spark: SparkSession, root: str, start, end,
                       campaigns: DataFrame | None = None,
                       updated_at: Column | None = None) -> DataFrame:
    """Recompute and store; returns the insights of the range after the run."""
    s, e = parse_day(start, "start_date"), parse_day(end, "end_date")
    if s is None or e is None:
        raise ValueError("start and end dates are required")
    if e < s:
        raise ValueError("end date before start date")
    stamp = updated_at if updated_at is not None else F.localtimestamp()
    if campaigns is None:
        refresh_days(spark, root, _days(s, e), stamp)
        return storage.read_insights(spark, root, s, e)
    facts = storage.read_facts(spark, root, start=s, end=e)
    current = storage.read_insights(spark, root, s, e, schema=None)
    if current is None:
        current = spark.createDataFrame([], rollup.daily_insights(facts, stamp).schema)
    merged = rollup.reaggregate(current, facts, s, e, campaigns, stamp)
    checkpoint_dir(spark)  # the days being rewritten are also read: cut the lineage first
    merged = merged.checkpoint(eager=True)
    left = {r[0] for r in merged.select("date").distinct().collect()}  # days of the range
    storage.write_insights(merged, root)
    storage.empty_insights(spark, root, sorted(set(_days(s, e)) - left))
    return merged


def reaggregate_requested(spark: SparkSession, root: str, requests: DataFrame,
                          campaigns: DataFrame, as_of: dt.date, start=None, end=None,
                          updated_at: Column | None = None) -> DataFrame:
    """The owner-checked request: J1 for ``(user_id, campaign_id)`` rows, F2's default range,
    then A9 for the campaigns that the requests may touch. Returns the requests with their
    ``access``; ``forbidden`` and ``not_found`` ones change nothing."""
    checked = insights.authorized_requests(requests, campaigns)
    allowed = checked.filter(F.col("access") == "ok").select("campaign_id").distinct()
    s, e = default_range(start, end, as_of)
    reaggregate_stored(spark, root, s, e, allowed, updated_at)
    return checked

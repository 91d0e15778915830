"""Roll-ups: daily insights (A1-A6), granularity (A7), incremental (A8), re-aggregation.

Amounts are summed as exact decimals and turned into doubles only at the end, so the result
does not depend on the order in which a shuffle delivers rows. Every roll-up is one
``groupBy`` (partial aggregate -> exchange on the group key -> final aggregate); the five ratio
columns reuse the same sums.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.functions.dates import check_granularity, ntz, period_start
from adperf.functions.ratios import ratio_columns
from adperf.operators.dedup import latest_facts

_SUM_TYPE = S.MONEY  # amounts stay decimal through the sums


def metric_sums() -> list[Column]:
    """Exact sums of the five metrics."""
    return ([F.sum(F.col(c).cast("long")).cast("long").alias(c) for c in S.COUNTERS]
            + [F.sum(F.col(c).cast(_SUM_TYPE)).alias(c) for c in S.AMOUNTS])


def _finish(grouped: DataFrame, keys: list[str], updated_at: Column | None) -> DataFrame:
    cols = ([F.col(k) for k in keys] + [F.col(c) for c in S.COUNTERS]
            + [F.col(c).cast("double").alias(c) for c in S.AMOUNTS] + ratio_columns())
    if updated_at is not None:
        cols.append(updated_at.alias("updated_at"))
    return grouped.select(*cols)


def daily_insights(facts: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """One row per ``(campaign_id, date, platform, region)`` with sums and ratios."""
    grouped = (facts.withColumn("date", F.to_date("event_time"))
               .groupBy(*S.INSIGHT_KEY).agg(*metric_sums()))
    return _finish(grouped, list(S.INSIGHT_KEY), updated_at)


def daily_sums_to_insights(sums: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Insights from rows that hold the sums of their key already."""
    return _finish(sums, list(S.INSIGHT_KEY), updated_at)


def insights_of(facts: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """D2 then A1: daily insights of stored or incoming facts, the last version of each fact
    counted once. Every path from facts to insights goes through here."""
    return daily_insights(latest_facts(facts), updated_at)


def regroup_insights(insights: DataFrame, granularity: str) -> DataFrame:
    """A7 over stored daily insights: re-sum the counters, recompute ratios from the sums.

    Stored amounts are doubles of decimals, so the cast back to decimal gives the sum's decimal
    (up to a double's 15 digits) and the re-sum is order-independent.
    """
    g = check_granularity(granularity)
    if g == "daily":
        return insights.select(*S.INSIGHT_COLUMNS)
    grouped = (insights.withColumn("date", period_start(F.col("date"), g))
               .groupBy(*S.INSIGHT_KEY).agg(*metric_sums()))
    return _finish(grouped, list(S.INSIGHT_KEY), None)


def regroup_insights_by(insights: DataFrame, granularity: str, extra_keys: list[str]) -> DataFrame:
    """:func:`regroup_insights` keeping ``extra_keys`` (e.g. the requesting user) as keys."""
    g = check_granularity(granularity)
    keys = list(S.INSIGHT_KEY) + list(extra_keys)
    grouped = (insights.withColumn("date", period_start(F.col("date"), g))
               .groupBy(*keys).agg(*metric_sums()))
    return _finish(grouped, keys, None)


def _signed_sums(facts: DataFrame, sign: int) -> DataFrame:
    one = F.lit(sign)
    return facts.select(
        "campaign_id", F.to_date("event_time").alias("date"), "platform", "region",
        *[(F.col(c).cast("long") * one).alias(c) for c in S.COUNTERS],
        *[(F.col(c).cast(_SUM_TYPE) * one).cast(_SUM_TYPE).alias(c) for c in S.AMOUNTS],
        one.cast("long").alias("n_facts"))


def _delta_sums() -> list[Column]:
    wide = "decimal(38,9)"
    return ([F.sum(c).alias(c) for c in S.COUNTERS]
            + [F.sum(c).cast(wide).alias(c) for c in S.AMOUNTS] + [F.sum("n_facts").alias("n_facts")])


def insight_deltas(new: DataFrame, before: DataFrame | None) -> DataFrame:
    """A8 as deltas: what the facts ``new`` add to and take from the daily sums.

    ``before`` holds the stored facts of the same fact keys (more do no harm). The last version
    of a key among both counts, the last one stored before no longer does: rows that lose, and
    rows delivered again, cancel out. ``n_facts`` is the change of the number of facts.
    """
    if before is None:
        signed = _signed_sums(latest_facts(new), 1)
    else:
        new = new.select(*before.columns)
        signed = _signed_sums(latest_facts(before.unionByName(new)), 1).unionByName(
            _signed_sums(latest_facts(before), -1))
    deltas = signed.groupBy(*S.INSIGHT_KEY).agg(*_delta_sums())
    changed = [F.col(c) != 0 for c in (*S.METRICS, "n_facts")]
    return deltas.filter(reduce(lambda a, b: a | b, changed))


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """The sum of delta rows per insight key; keys without any fact left are gone."""
    return deltas.groupBy(*S.INSIGHT_KEY).agg(*_delta_sums()).filter(F.col("n_facts") > 0)


def insights_of_deltas(deltas: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """A1-A6 from delta rows: the same rows as :func:`insights_of` over all facts."""
    return _finish(merge_deltas(deltas), list(S.INSIGHT_KEY), updated_at)


def touched_days(new_facts: DataFrame) -> DataFrame:
    """``(campaign_id, date)`` keys a batch of facts changes."""
    return new_facts.select("campaign_id", F.to_date("event_time").alias("date")).distinct()


def apply_increment(current: DataFrame | None, new_facts: DataFrame, all_facts: DataFrame,
                    updated_at: Column | None = None) -> DataFrame:
    """New insight table after a batch of facts.

    Days the batch touches are recomputed from *all* facts (so a replayed batch cannot double
    count); every other row of ``current`` is kept. ``all_facts`` should already include the
    batch; ``current`` None means there is no table yet.
    """
    touched = touched_days(new_facts)
    affected = (all_facts.withColumn("date", F.to_date("event_time"))
                .join(touched, ["campaign_id", "date"], "left_semi").drop("date"))
    recomputed = insights_of(affected, updated_at)
    if current is None:
        return recomputed
    kept = current.join(touched, ["campaign_id", "date"], "left_anti")
    return kept.unionByName(recomputed.select(*kept.columns))


def day_range_filter(facts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """F6 with whole days: ``start <= event_time < end + 1 day``."""
    lo, hi = ntz(start), ntz(end + dt.timedelta(days=1))
    return facts.filter((F.col("event_time") >= lo) & (F.col("event_time") < hi))


def reaggregate(current: DataFrame, facts: DataFrame, start: dt.date, end: dt.date,
                campaigns: DataFrame | None = None, updated_at: Column | None = None) -> DataFrame:
    """Insights of ``campaigns`` (all when None) over whole days ``start..end``, recomputed
    from last-wins facts. Every row of those campaigns and days is replaced, so a key that the
    facts no longer have (a corrected region, say) does not stay behind.
    """
    if end < start:
        raise ValueError("end date before start date")
    scoped = day_range_filter(facts, start, end)
    in_range = F.col("date").between(F.lit(start), F.lit(end))
    outside = current.filter(~in_range)
    if campaigns is not None:
        ids = campaigns.select("campaign_id").distinct()
        scoped = scoped.join(ids, "campaign_id", "left_semi")
        outside = outside.unionByName(current.filter(in_range).join(ids, "campaign_id",
                                                                    "left_anti"))
    recomputed = insights_of(scoped, updated_at)
    return outside.unionByName(recomputed.select(*outside.columns))

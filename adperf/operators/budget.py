"""Budget tracking: increment validation (U4), spend accumulation (A10), status.

:func:`running_spend` answers every accepted update with the stored total after it, and names
the update at which a campaign becomes overspent.

Spend increments are summed per campaign with a partial aggregate before the shuffle (a
campaign with a third of all increments is reduced map-side), then joined to the budget
dimension; the join reuses the aggregate's hash partitioning on ``campaign_id`` so only the
budget side is exchanged. Amounts are decimals until the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.operators.running import running_sum

SPEND_TYPE = "decimal(18,2)"


def _increment_reason() -> F.Column:
    amount = F.col("spend")
    return (F.when(F.col("campaign_id").isNull(), F.lit(S.REJECT_CAMPAIGN_REQUIRED))
            .when(amount.isNull() | (amount == 0), F.lit(S.REJECT_SPEND_REQUIRED))
            .when(amount < 0, F.lit(S.REJECT_SPEND_NEGATIVE)))


def split_increments(increments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4: ``(valid, rejects)``. A missing, zero or negative amount is rejected; a missing
    campaign id is rejected too. ``rejects`` carries ``reason``."""
    tagged = increments.withColumn("reason", _increment_reason())
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


def spend_totals(increments: DataFrame) -> DataFrame:
    """A10: ``(campaign_id, spend)`` - the stored total after adding every increment."""
    return increments.groupBy("campaign_id").agg(
        F.sum(F.col("spend").cast(SPEND_TYPE)).alias("spend"))


def budget_status(budgets: DataFrame, totals: DataFrame) -> DataFrame:
    """``remaining = budget - spend``; ``Overspent`` when ``remaining <= 0``.

    ``budgets`` is ``(id, budget[, spend])`` - a stored spend, when present, is added to the
    increments. Campaigns without increments have spend 0.
    """
    base = budgets.select(F.col("id").alias("campaign_id"), F.col("budget"),
                          (F.col("spend") if "spend" in budgets.columns else F.lit(0))
                          .cast(SPEND_TYPE).alias("_stored"))
    joined = base.join(totals.withColumnRenamed("spend", "_added"), "campaign_id", "left")
    spend = (F.coalesce(F.col("_stored"), F.lit(0).cast(SPEND_TYPE))
             + F.coalesce(F.col("_added"), F.lit(0).cast(SPEND_TYPE)))
    remaining = F.col("budget").cast(SPEND_TYPE) - F.col("spend_d")
    return (joined.withColumn("spend_d", spend)
            .select("campaign_id",
                    F.col("budget").cast("double").alias("budget"),
                    F.col("spend_d").cast("double").alias("spend"),
                    remaining.cast("double").alias("remaining"),
                    F.when(remaining <= 0, F.lit(S.STATUS_OVERSPENT))
                     .otherwise(F.lit(S.STATUS_ACTIVE)).alias("status")))


def running_spend(increments: DataFrame, campaigns: DataFrame,
                  order: list[str]) -> DataFrame:
    """A10 per update: every accepted increment (valid, of a known campaign) with ``new_spend``,
    the campaign's total after it, ``remaining``, ``status`` and ``became_overspent``, true for
    the one update that takes the campaign from Active to Overspent.

    ``campaigns`` is ``(id, budget[, spend])``; a stored spend counts before the first update.
    Updates are applied by ``order``; the columns of ``increments`` are kept.
    """
    valid, _ = split_increments(increments)
    stored = F.col("spend") if "spend" in campaigns.columns else F.lit(0)
    known = campaigns.select(F.col("id").alias("campaign_id"), F.col("budget").alias("_budget"),
                             F.coalesce(stored, F.lit(0)).cast(SPEND_TYPE).alias("_stored"))
    valid = valid.withColumn("spend", F.col("spend").cast(SPEND_TYPE))
    accepted = valid.join(known, "campaign_id")
    summed = running_sum(accepted, "campaign_id", [*order, "spend"], "spend", "_added")
    total = F.col("_stored") + F.col("_added")
    left = F.col("_budget").cast(SPEND_TYPE) - total
    return summed.select(
        *valid.columns, total.alias("new_spend"), left.alias("remaining"),
        F.when(left <= 0, F.lit(S.STATUS_OVERSPENT)).otherwise(F.lit(S.STATUS_ACTIVE))
        .alias("status"),
        ((left <= 0) & (left + F.col("spend") > 0)).alias("became_overspent"))


def increment_rejects(increments: DataFrame, campaigns: DataFrame) -> DataFrame:
    """U4 + J3 in one pass: invalid increments and increments of unknown campaigns, with
    ``reason``. One left join to the campaign keys; the increments are scanned once."""
    known = (campaigns.select(F.col("id").alias("campaign_id")).distinct()
                     .withColumn("_known", F.lit(True)))
    reason = F.coalesce(_increment_reason(),
                        F.when(F.col("_known").isNull(), F.lit(S.REJECT_CAMPAIGN_NOT_FOUND)))
    return (increments.join(known, "campaign_id", "left")
            .withColumn("reason", reason)
            .filter(F.col("reason").isNotNull())
            .drop("_known"))

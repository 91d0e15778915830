"""Constraint audits over whole tables: uniqueness (C1), references (C2), not-null (C3),
domains (C4).

The database constraints of the original become checks that report violations instead of
refusing writes. Each audit is one aggregate or one anti join; the not-null and domain audits
compute every column's count in a single pass and unpivot the one-row result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf import schemas as S


def duplicate_keys(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Every key value held by more than one row, with its row count ``n``."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def missing_references(child: DataFrame, child_key: str, parent: DataFrame,
                       parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")


def reference_summary(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """C2 for several constraints: ``(constraint_name, checked_rows, violations)``."""
    frames = []
    for name, (child, ck, parent, pk) in checks.items():
        parents = (parent.select(F.col(pk).alias("_pk"), F.lit(True).alias("_hit"))
                           .distinct())
        frames.append(child.select(F.col(ck).alias("_pk"))
                      .join(parents, "_pk", "left")
                      .agg(F.count(F.lit(1)).alias("checked_rows"),
                           F.count_if(F.col("_pk").isNotNull() & F.col("_hit").isNull())
                           .alias("violations"))
                      .select(F.lit(name).alias("constraint_name"), "checked_rows",
                              "violations"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _counts(df: DataFrame, counts: dict[str, Column], label: str, value: str) -> DataFrame:
    """One aggregate pass, then one row per named count (explode of a literal-sized array)."""
    row = df.agg(*[c.cast("long").alias(f"_n{i}") for i, c in enumerate(counts.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias(label), F.col(f"_n{i}").alias(value))
                      for i, name in enumerate(counts)])
    return row.select(F.explode(pairs).alias("_p")).select("_p.*")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, null_count)`` for every column, one scan."""
    columns = columns or df.columns
    return _counts(df, {c: F.count_if(F.col(c).isNull()) for c in columns},
                   "column_name", "null_count")


def domain_checks(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """C4: ``(check_name, violations)``; each check is a boolean column, true = violation."""
    return _counts(df, {n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in checks.items()},
                   "check_name", "violations")


def campaign_domain_checks(columns: list[str] | None = None) -> dict[str, Column]:
    """Domain rules of the campaign table: decimal(12,2) budget, varchar limits, platform.

    Limits are checked for ``columns``, those that the source has (default: platform, status).
    """
    limits = {c: n for c, n in S.VARCHAR_LIMITS["campaigns"].items()
              if c in (columns if columns is not None else ("platform", "status"))}
    checks = {
        "budget_decimal_12_2": F.col("budget").isNotNull()
        & F.col("budget").try_cast("decimal(12,2)").isNull(),
        "platform_enum": F.col("platform").isNotNull() & ~F.col("platform").isin(*S.PLATFORMS),
    }
    for c, limit in limits.items():
        checks[f"{c}_length"] = F.length(F.col(c).cast("string")) > limit
    checks["end_before_start"] = F.col("end_date") < F.col("start_date")
    return checks


def user_domain_checks() -> dict[str, Column]:
    """Domain rules of the user table: varchar limits."""
    return {f"{c}_length": F.length(F.col(c).cast("string")) > limit
            for c, limit in S.VARCHAR_LIMITS["users"].items()}


def event_domain_checks() -> dict[str, Column]:
    """Domain rules of the event stream: known platform, non-negative metrics."""
    checks = {"platform_enum": F.col("platform").isNotNull()
              & ~F.col("platform").isin(*S.PLATFORMS)}
    for m in S.METRICS:
        checks[f"{m}_negative"] = F.col(m) < 0
    return checks


def mixed_currency(facts: DataFrame) -> DataFrame:
    """Campaigns whose facts carry more than one currency (amounts would be mixed)."""
    return (facts.groupBy("campaign_id").agg(F.countDistinct("currency").alias("currencies"))
            .filter(F.col("currencies") > 1))

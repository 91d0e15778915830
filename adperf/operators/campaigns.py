"""Campaign dimension: list (F3, O2), lookup (F4), insert (U1, U3), update (U2), orphans.

Row-at-a-time database calls become set operations over a batch of requests or changes:
lookups are a left join of request keys, inserts an anti join against the target, updates a
left join of the target with the latest change per id. Latest-change selection is an
aggregate (map-side combine), so an id with millions of changes is reduced before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf.functions.keys import deterministic_uuid, is_missing_id
from adperf.operators.dedup import last_wins
from adperf.operators.insights import authorized_requests

# Columns an update replaces; ``user_id`` and ``created_at`` are kept from the target.
UPDATED_COLUMNS = ("name", "platform", "budget", "start_date", "end_date", "status",
                   "external_id", "updated_at")


def list_campaigns(campaigns: DataFrame, user_id=None, platform: str | None = None,
                   status: str | None = None, users: DataFrame | None = None,
                   ordered: bool = True) -> DataFrame:
    """F3 + O2: campaigns of one user (``user_id``) or of a set of users (``users``),
    optionally of one platform and one status, newest first (ties by id)."""
    out = campaigns
    if user_id is not None:
        out = out.filter(F.col("user_id") == F.lit(user_id))
    if users is not None:
        out = out.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if platform is not None:
        out = out.filter(F.col("platform") == F.lit(platform))
    if status is not None:
        out = out.filter(F.col("status") == F.lit(status))
    if ordered:
        out = out.orderBy(F.col("user_id"), F.col("created_at").desc(), F.col("id"))
    return out


def lookup_campaigns(campaigns: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """F4 for a batch of requested ids: every request once, ``found`` flag, campaign columns
    (null when not found)."""
    req = requests.select(F.col(key).alias("id")).distinct()
    marked = campaigns.withColumn("_found", F.lit(True))
    return (req.join(marked, "id", "left")
            .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found"))


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str = "id",
                     now: Column | None = None, order: str = "created_at"
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U1 + U3: append incoming rows whose key is new; report the rest as conflicts.

    Missing ids get a deterministic id; ``created_at`` / ``updated_at`` default to ``now``.
    Within the batch the first row per key (by ``order``, then by all columns) wins, whatever the
    partitioning; the others are conflicts too.
    Returns ``(new_table, inserted, conflicts)``; ``conflicts`` has a ``reason`` column.
    """
    now = now if now is not None else F.localtimestamp()
    inc = incoming
    if isinstance(target.schema[key].dataType, T.StringType):
        fill = deterministic_uuid(*[F.col(c) for c in inc.columns if c != key])
    else:
        fill = F.xxhash64(*[F.col(c) for c in inc.columns if c != key]).cast(
            target.schema[key].dataType)
    inc = inc.withColumn(key, F.when(is_missing_id(F.col(key)), fill).otherwise(F.col(key)))
    for c in ("created_at", "updated_at"):
        if c in target.columns:
            if c in inc.columns:
                inc = inc.withColumn(c, F.coalesce(F.col(c), now.cast(target.schema[c].dataType)))
            else:
                inc = inc.withColumn(c, now.cast(target.schema[c].dataType))
    inc = inc.select(*target.columns)
    rest = [c for c in inc.columns if c not in (key, order)]
    # one aggregate with map-side combine: the first row per key by (order, all columns), and
    # how often each distinct row came
    same = inc.groupBy(*inc.columns).agg(F.count(F.lit(1)).alias("_n"))
    first = (inc.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_w"))
             .select(key, "_w.*").select(*target.columns))
    marked = same.join(first.withColumn("_first", F.lit(True)),
                       [same[c].eqNullSafe(first[c]) for c in target.columns], "left") \
        .select(*[same[c] for c in target.columns], "_n", "_first")
    again = F.col("_n") - F.when(F.col("_first"), 1).otherwise(0)
    in_batch_dups = (marked.withColumn("_copy", F.explode(F.when(
        again > 0, F.sequence(F.lit(1), again.cast("int"))))).select(*target.columns)
                     .withColumn("reason", F.lit("duplicate in batch")))
    known = target.select(key).distinct()
    existing = first.join(known, key, "left_semi").withColumn("reason", F.lit("already exists"))
    inserted = first.join(known, key, "left_anti").select(*target.columns)
    return (target.unionByName(inserted), inserted,
            existing.select(*target.columns, "reason").unionByName(in_batch_dups))


def apply_updates(target: DataFrame, changes: DataFrame, key: str = "id",
                  changed_at: str = "updated_at", tie: str | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """U2 + J3: apply a change feed to the campaign table.

    The latest change per id (by ``changed_at``, then ``tie``) replaces the
    :data:`UPDATED_COLUMNS`; a column the change lacks is written as null, as an update
    with a missing field writes the zero value. ``user_id`` and ``created_at`` are kept.
    Returns ``(new_table, orphans)``: changes for unknown ids are orphans.
    """
    order = [changed_at] + ([tie] if tie else [])
    latest = last_wins(changes, [key], order)
    replaced = [c for c in UPDATED_COLUMNS if c in target.columns]
    fields = [F.col(c).alias(f"_c_{c}") if c in latest.columns
              else F.lit(None).cast(target.schema[c].dataType).alias(f"_c_{c}")
              for c in replaced]
    chg = latest.select(F.col(key), F.lit(True).alias("_hit"), *fields)
    joined = target.join(chg, key, "left")
    cols = []
    for c in target.columns:
        if c in replaced:
            cols.append(F.when(F.col("_hit"), F.col(f"_c_{c}").cast(target.schema[c].dataType))
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    orphans = latest.join(target.select(key), key, "left_anti")
    return joined.select(*cols), orphans


def apply_owned_updates(target: DataFrame, changes: DataFrame, key: str = "id",
                        changed_at: str = "updated_at", tie: str | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """U2 + J1: apply the changes whose ``user_id`` owns the campaign.

    Every change is judged before the latest one per id is taken, so a stranger's later change
    never hides the owner's. Returns ``(new_table, refused)``; ``refused`` holds the other
    changes with ``access``: ``forbidden`` or ``not_found``.
    """
    judged = authorized_requests(changes.withColumnRenamed(key, "campaign_id"), target.select(
        F.col(key).alias("id"), "user_id")).withColumnRenamed("campaign_id", key)
    own = judged.filter(F.col("access") == "ok").drop("access", "user_id")
    updated, _ = apply_updates(target, own, key, changed_at, tie)
    return updated, judged.filter(F.col("access") != "ok")


def orphans(rows: DataFrame, campaigns: DataFrame, key: str = "campaign_id",
            campaign_key: str = "id") -> DataFrame:
    """Rows that reference a campaign that does not exist."""
    known = campaigns.select(F.col(campaign_key).alias(key)).distinct()
    return rows.join(known, key, "left_anti")

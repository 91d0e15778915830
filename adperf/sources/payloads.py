"""Landed platform payloads (S8) -> campaign events.

A platform's insights response is a JSON document with a ``data`` array of daily rows and a
``paging`` block. Pages are landed as files under ``<root>/platform=<name>/``, each with the
``external_id`` of its campaign beside the response's own fields: a folder per platform, not per
campaign, so listing does not grow with the campaigns. Every page is read. Flattening is
``explode``; the campaign id comes from a join with the campaign dimension on
``(platform, external_id)``; rows of an unknown platform or campaign go to rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import try_day
from adperf.functions.keys import dedup_key, deterministic_uuid

# Payload field -> event field.
FIELD_MAP = (("impressions", "impressions"), ("clicks", "clicks"), ("actions", "conversions"),
             ("spend", "spend"), ("action_values", "revenue"))


def read_payloads(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Every landed page with its ``platform`` and ``external_id``.

    ``multi_line`` reads one (possibly pretty-printed) document per file, as an API response
    is saved; ``False`` reads JSON Lines, one page per line."""
    schema = T.StructType(S.PAYLOAD_SCHEMA.fields + [
        T.StructField("platform", T.StringType()), T.StructField("external_id", T.StringType())])
    return spark.read.schema(schema).option("multiLine", multi_line).json(root)


def flatten_payloads(pages: DataFrame) -> DataFrame:
    """P8 + P9: one event row per ``data`` item of every page.

    ``date_start`` must be ``YYYY-MM-DD`` (null otherwise; validation rejects it). The dedup
    key is ``<platform>:<external id>:<date>``.
    """
    items = pages.select("platform", F.col("external_id").cast("string").alias("external_id"),
                         F.explode("data").alias("d"))
    day = try_day(F.col("d.date_start"))
    cols = [F.col("platform"), F.col("external_id"),
            F.lit(S.PAYLOAD_EVENT_TYPE).alias("event_type")]
    for src, dst in FIELD_MAP:
        c = F.col(f"d.{src}")
        cols.append((c.cast(S.MONEY) if dst in S.AMOUNTS else c.cast("long")).alias(dst))
    cols += [day.cast("timestamp_ntz").alias("event_time"),
             F.lit(S.DEFAULT_REGION).alias("region"),
             F.lit(S.DEFAULT_CURRENCY).alias("currency"),
             dedup_key(F.col("platform"), F.col("external_id"), day).alias("deduplication_key")]
    return items.select(*cols)


# One adapter per platform turns landed pages into event rows. All platforms
# deliver the insights shape above; a platform with another shape registers its own function.
ADAPTERS: dict = {p: flatten_payloads for p in S.PLATFORMS}


def register_adapter(platform: str, fn) -> None:
    ADAPTERS[platform] = fn


def adapt_pages(pages: DataFrame) -> DataFrame:
    """Route every platform's pages through its adapter and union the results; pages of
    a platform without an adapter keep their rows with that platform so that
    :func:`route_to_campaigns` rejects them as ``unknown platform``."""
    by_adapter: dict = {}  # platforms that share an adapter share its scan
    for p, fn in ADAPTERS.items():
        by_adapter.setdefault(fn, []).append(p)
    by_adapter.setdefault(flatten_payloads, [])
    parts = []
    for fn, ps in by_adapter.items():
        own = F.col("platform").isin(*ps)
        if fn is flatten_payloads:  # and whatever no adapter claims
            own = own | ~F.coalesce(F.col("platform").isin(*ADAPTERS), F.lit(False))
        parts.append(fn(pages.filter(own)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def route_to_campaigns(events: DataFrame, campaigns: DataFrame
                       ) -> tuple[DataFrame, DataFrame]:
    """P10 + P11 + J4: attach the internal campaign id by ``(platform, external_id)``.

    Returns ``(events, rejects)``; rejects carry ``reason`` (``unknown platform`` /
    ``unknown campaign``). The event id is derived from the dedup key, so a re-fetch of the
    same day yields the same id.
    """
    dim = campaigns.select(F.col("id").alias("campaign_id"), "platform", "external_id")
    known = F.col("platform").isin(*S.PLATFORMS)
    routed = events.join(dim, ["platform", "external_id"], "left")
    reason = (F.when(~known | F.col("platform").isNull(), F.lit("unknown platform"))
              .when(F.col("campaign_id").isNull(), F.lit("unknown campaign")))
    tagged = routed.withColumn("reason", reason)
    id_type = campaigns.schema["id"].dataType.simpleString()
    ev_id = (deterministic_uuid(F.col("deduplication_key")) if id_type == "string"
             else F.xxhash64(F.col("deduplication_key")))
    good = (tagged.filter(F.col("reason").isNull())
            .withColumn("id", ev_id)
            .drop("reason", "external_id"))
    return good, tagged.filter(F.col("reason").isNotNull())


def pack_payloads(daily: DataFrame) -> DataFrame:
    """Inverse of :func:`flatten_payloads` for landing test pages: one page per
    ``(platform, external_id, month)`` - at most 31 data rows, so the array is bounded."""
    item = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date_start"),
        F.date_format("date", "yyyy-MM-dd").alias("date_stop"),
        F.col("impressions").cast("long").alias("impressions"),
        F.col("clicks").cast("long").alias("clicks"),
        F.col("conversions").cast("long").alias("actions"),
        F.col("spend").cast("double").alias("spend"),
        F.col("revenue").cast("double").alias("action_values"))
    return (daily.withColumn("_m", F.date_trunc("month", "date"))
            .groupBy("platform", "external_id", "_m")
            .agg(F.array_sort(F.collect_list(item)).alias("data"))
            .withColumn("paging", F.struct(
                F.struct(F.lit(None).cast("string").alias("before"),
                         F.lit(None).cast("string").alias("after")).alias("cursors"),
                F.lit(None).cast("string").alias("next")))
            .drop("_m"))

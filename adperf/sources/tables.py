"""Driver tables and the adapter views that give them the ad-analytics shapes.

The driver ships TPC-H-like tables plus an ``events`` table. Three adapter views turn them into
the inputs of this engine (exact definitions in FIXTURES.md §3):

- :func:`ad_events_raw`  events + customer + nation + region -> raw campaign events
- :func:`ad_campaigns`   orders -> campaign dimension with budgets
- :func:`spend_increments` lineitem -> spend increments per campaign
- :func:`ad_owners`      customer -> owner of each event campaign

Joins carry no broadcast hint: the planner broadcasts a side whose byte size it knows to be
under its threshold, and AQE switches at run time by measured bytes.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf import schemas as S
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events")



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filter pushdown reach the Parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def platform_of(key: Column) -> Column:
    """Round-robin platform assignment of the adapter views (``key % 4``)."""
    return (F.when(key % 4 == 0, F.lit(S.PLATFORMS[0]))
            .when(key % 4 == 1, F.lit(S.PLATFORMS[1]))
            .when(key % 4 == 2, F.lit(S.PLATFORMS[2]))
            .otherwise(F.lit(S.PLATFORMS[3])))


CENTS = "decimal(18,2)"  # the driver's values are amounts of whole cents


def money(c: Column | str) -> Column:
    return F.col(c).cast(CENTS) if isinstance(c, str) else c.cast(CENTS)


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, r_name): customer -> nation -> region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation_region = (nation.join(region,
                                 nation.n_regionkey == region.r_regionkey)
                     .select("n_nationkey", "r_name"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (customer.join(nation_region,
                          customer.c_nationkey == nation_region.n_nationkey)
            .select("c_custkey", "r_name"))


def ad_events_raw(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Raw campaign events from the driver ``events`` table.

    ``error`` events get no platform so that validation has something to reject; clicks cost
    ``value - 5`` so that the clamp has negatives to fix. ``events`` may be a streaming
    DataFrame with the driver schema (stream-static join).
    """
    ev = events if events is not None else table(spark, sf_dir, "events")
    ev = ev.select("event_id", "user_id", "event_type", "value", "ts")
    et = F.col("event_type")
    joined = ev.join(customer_regions(spark, sf_dir), ev.user_id == F.col("c_custkey"))
    return joined.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("campaign_id"),
        F.when(et == "error", F.lit(None).cast("string"))
         .otherwise(platform_of(F.col("user_id"))).alias("platform"),
        et.alias("event_type"),
        F.when(et == "view", F.lit(10)).otherwise(F.lit(0)).cast("long").alias("impressions"),
        F.when(et == "click", F.lit(1)).otherwise(F.lit(0)).cast("long").alias("clicks"),
        F.when(et.isin("signup", "purchase"), F.lit(1)).otherwise(F.lit(0))
         .cast("long").alias("conversions"),
        F.when(et == "click", money("value") - F.lit(5).cast(CENTS))
         .otherwise(F.lit(0).cast(CENTS)).cast(S.MONEY).alias("spend"),
        F.when(et == "purchase", money("value"))
         .otherwise(F.lit(0).cast(CENTS)).cast(S.MONEY).alias("revenue"),
        F.col("ts").alias("event_time"),
        F.col("r_name").alias("region"),
    )


def with_driver_event_fields(raw: DataFrame, key_parts: tuple[str, ...] = (
        "platform", "campaign_id", "event_type", "day")) -> DataFrame:
    """Add the stream fields the driver events lack.

    ``deduplication_key`` joins ``key_parts`` with ``:`` (``day`` is the event date as
    ``yyyy-MM-dd``); ``received_at`` / ``processed_at`` are the event time, so replays of
    the same rows give the same result.
    """
    parts = [F.date_format("event_time", "yyyy-MM-dd") if p == "day" else F.col(p).cast("string")
             for p in key_parts]
    return (raw
            .withColumn("currency", F.lit(None).cast("string"))
            .withColumn("deduplication_key", F.concat_ws(":", *parts))
            .withColumn("received_at", F.col("event_time"))
            .withColumn("processed_at", F.col("event_time")))


def ad_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign dimension from ``orders``: budget, 90-day flight, status, owner."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        platform_of(F.col("o_orderkey")).alias("platform"),
        F.col("o_totalprice").cast(S.BUDGET).alias("budget"),
        F.col("o_orderdate").alias("start_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("end_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def spend_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campaign_id, spend): one increment per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("campaign_id"),
                     F.col("l_extendedprice").cast(S.BUDGET).alias("spend"))


def ad_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campaign_id, user_id): owner of each campaign of :func:`ad_events_raw`."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("campaign_id"), F.col("c_nationkey").cast("long").alias("user_id"))

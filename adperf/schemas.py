"""Schemas and fixed values of the data model.

Fixed values below must equal the original system's for equal results; they are stated
together, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------
PLATFORMS = ("meta", "google", "linkedin", "tiktok")
DEFAULT_EVENT_TYPE = "stats"
DEFAULT_REGION = "all"
DEFAULT_CURRENCY = "USD"
PAYLOAD_EVENT_TYPE = "daily_stats"
REJECT_MISSING_CAMPAIGN = "missing campaign ID"
REJECT_MISSING_PLATFORM = "missing platform"
REJECT_MISSING_EVENT_TIME = "missing event time"
REJECT_MISSING_DEDUP_KEY = "missing deduplication key"
REJECT_CAMPAIGN_REQUIRED = "campaign ID is required"
REJECT_SPEND_REQUIRED = "spend is required"
REJECT_SPEND_NEGATIVE = "spend amount cannot be negative"
REJECT_CAMPAIGN_NOT_FOUND = "campaign not found"
DEDUP_TTL_DAYS = 7
FETCH_LOOKBACK_DAYS = 30
DEFAULT_RANGE_DAYS = 30
GRANULARITIES = ("daily", "weekly", "monthly")
STATUS_ACTIVE = "Active"
STATUS_OVERSPENT = "Overspent"
NIL_UUID = "00000000-0000-0000-0000-000000000000"
# -------------------------------------------------------------------------------------------

REJECT_AMOUNT = "amount out of range"

# Amounts keep nine decimal places from decode to output: per-event spend is often below a cent.
MONEY = T.DecimalType(27, 9)
BUDGET = T.DecimalType(12, 2)

# Metric columns in their stored order.
COUNTERS = ("impressions", "clicks", "conversions")
AMOUNTS = ("spend", "revenue")
METRICS = COUNTERS + AMOUNTS
RATIOS = ("ctr", "cpc", "cpa", "roas", "conversion_rate")

# Keys of the stored tables.
FACT_KEY = ("campaign_id", "event_time", "deduplication_key")
INSIGHT_KEY = ("campaign_id", "date", "platform", "region")
INSIGHT_COLUMNS = INSIGHT_KEY + METRICS + RATIOS


def event_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """Campaign event as it travels on the stream and is stored as a fact.

    ``id_type`` is ``StringType`` for UUID ids and ``LongType`` over the driver tables.
    Amounts are exact decimals so that shuffled sums do not depend on row order.
    """
    return T.StructType([
        T.StructField("id", id_type),
        T.StructField("campaign_id", id_type),
        T.StructField("platform", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("conversions", T.LongType()),
        T.StructField("spend", MONEY),
        T.StructField("revenue", MONEY),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("region", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("deduplication_key", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
    ])


EVENT_SCHEMA = event_schema()

INSIGHT_SCHEMA = T.StructType([
    T.StructField("campaign_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("platform", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("conversions", T.LongType()),
    T.StructField("spend", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("ctr", T.DoubleType()),
    T.StructField("cpc", T.DoubleType()),
    T.StructField("cpa", T.DoubleType()),
    T.StructField("roas", T.DoubleType()),
    T.StructField("conversion_rate", T.DoubleType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

CAMPAIGN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("budget", BUDGET),
    T.StructField("start_date", T.TimestampNTZType()),
    T.StructField("end_date", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

USER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

CREDENTIAL_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("credentials", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

# Platform insights payload: ``data`` rows plus a paging block.
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("date_start", T.StringType()),
        T.StructField("date_stop", T.StringType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("actions", T.LongType()),
        T.StructField("spend", T.DoubleType()),
        T.StructField("action_values", T.DoubleType()),
    ]))),
    T.StructField("paging", T.StructType([
        T.StructField("cursors", T.StructType([
            T.StructField("before", T.StringType()),
            T.StructField("after", T.StringType()),
        ])),
        T.StructField("next", T.StringType()),
    ])),
])

# Column length limits of the campaign and user tables (domain audit).
VARCHAR_LIMITS = {
    "campaigns": {"name": 255, "platform": 50, "status": 50, "external_id": 255},
    "users": {"email": 255, "name": 255, "role": 50},
}

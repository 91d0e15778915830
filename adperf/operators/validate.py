"""Event validation and normalisation.

One projection computes, per row: a default id, the first failing required-field check as
``reject_reason`` (null when the row is valid), non-negative metrics, field defaults and the
processing stamp. Accepted and rejected rows are then two filters of the same DataFrame, so
the split costs no extra pass when the result is cached or written once with both outputs.
Everything is built-in expressions inside whole-stage codegen; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.keys import deterministic_uuid, is_missing_id

# The zero time of the messages, read as "missing".
_ZERO_TIME = "0001-01-01 00:00:00"


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _bad_amount() -> Column:
    """An amount is given but does not fit the stored type."""
    bad = [F.col(m).isNotNull() & F.col(m).try_cast(S.MONEY).isNull() for m in S.AMOUNTS]
    return bad[0] | bad[1]


def _missing_time(c: Column) -> Column:
    return c.isNull() | (c == F.lit(_ZERO_TIME).cast(T.TimestampNTZType()))


def _default_text(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)


def with_reject_reason(df: DataFrame, prior: Column | None = None) -> DataFrame:
    """Add ``reject_reason``: first failing check in the original order, else null.

    ``prior`` is a reason found before validation (a decode error); it wins when not null.
    """
    reason = (F.when(prior.isNotNull() if prior is not None else F.lit(False), prior)
              .when(is_missing_id(F.col("campaign_id")), F.lit(S.REJECT_MISSING_CAMPAIGN))
              .when(_blank(F.col("platform")), F.lit(S.REJECT_MISSING_PLATFORM))
              .when(_missing_time(F.col("event_time")), F.lit(S.REJECT_MISSING_EVENT_TIME))
              .when(_blank(F.col("deduplication_key")), F.lit(S.REJECT_MISSING_DEDUP_KEY))
              .when(_bad_amount(), F.lit(S.REJECT_AMOUNT)))
    return df.withColumn("reject_reason", reason)


def normalise(df: DataFrame, now: Column | None = None,
              processed_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Defaults, clamps and stamps; keeps ``reject_reason`` and the ``keep`` columns.

    ``now`` stands in for the wall clock (``received_at`` default); ``processed_at`` defaults
    to ``now``. Pass fixed columns for replayable results.
    """
    now = now if now is not None else F.localtimestamp()
    processed_at = processed_at if processed_at is not None else now
    id_type = df.schema["id"].dataType
    if isinstance(id_type, T.StringType):
        default_id = deterministic_uuid(F.col("deduplication_key"), F.col("campaign_id"),
                                        F.col("event_time"))
    else:
        default_id = F.xxhash64(F.col("deduplication_key"), F.col("campaign_id"),
                                F.col("event_time")).cast(id_type)
    cols = [
        F.when(is_missing_id(F.col("id")), default_id).otherwise(F.col("id")).alias("id"),
        F.col("campaign_id"),
        F.col("platform"),
        _default_text("event_type", S.DEFAULT_EVENT_TYPE),
    ]
    for m in S.COUNTERS:
        cols.append(F.greatest(F.coalesce(F.col(m).cast("long"), F.lit(0)), F.lit(0))
                    .cast("long").alias(m))
    zero = F.lit(0).cast(S.MONEY)
    for m in S.AMOUNTS:
        cols.append(F.greatest(F.coalesce(F.col(m).try_cast(S.MONEY), zero), zero)
                    .cast(S.MONEY).alias(m))
    cols += [
        F.col("event_time"),
        _default_text("region", S.DEFAULT_REGION),
        _default_text("currency", S.DEFAULT_CURRENCY),
        F.col("deduplication_key"),
        F.when(_missing_time(F.col("received_at")), now).otherwise(F.col("received_at"))
         .cast(T.TimestampNTZType()).alias("received_at"),
        processed_at.cast(T.TimestampNTZType()).alias("processed_at"),
    ]
    if "reject_reason" in df.columns:
        cols.append(F.col("reject_reason"))
    cols += [F.col(c) for c in keep if c in df.columns]
    return df.select(*cols)


def validate(df: DataFrame, now: Column | None = None, processed_at: Column | None = None,
             prior: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Validated and normalised events with a ``reject_reason`` column."""
    return normalise(with_reject_reason(df, prior), now=now, processed_at=processed_at,
                     keep=keep)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNotNull())

"""Event stream source (S1), sink encoding (S2) and strict JSON decode.

The stream carries one JSON document per message with the campaign id as key. Any streaming
source that yields a ``value`` column works: Kafka (``format("kafka")``, when its connector
is on the classpath), or the text / JSON file sources used in tests. Decoding is
``from_json`` with an explicit schema - no inference, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.sources import message_log

CORRUPT = "_corrupt"
# RFC 3339 with an optional fraction of 1-9 digits and an optional offset;
# Spark keeps microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]"
# Writing keeps microseconds (the default JSON writer cuts to milliseconds).
WRITE_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                 "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def event_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                 options: dict | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A streaming DataFrame with string ``key`` and ``value`` columns.

    Kafka: pass ``subscribe`` / ``kafka.bootstrap.servers`` in ``options``; reading starts at
    the earliest offset unless ``startingOffsets`` says otherwise, as from a message log
    (``adperf_log``, :mod:`adperf.sources.message_log`). File formats: ``path`` is the landing
    folder; ``text`` gives one message per line.
    """
    opts = dict(options or {})
    if fmt == message_log.FORMAT:
        message_log.register(spark)
    if fmt == "kafka":
        opts.setdefault("startingOffsets", "earliest")
    reader = spark.readStream.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path) if path else reader.load()
    key = F.col("key").cast("string") if "key" in df.columns else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.col("value").cast("string").alias("value"))


def encode_events(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    """``(key, value)`` with the row as a JSON document; text values pass through."""
    if df.columns == ["value"] or set(df.columns) == {"key", "value"}:
        return df.select(F.col(key).cast("string").alias("key") if key in df.columns
                         else F.lit(None).cast("string").alias("key"),
                         F.col("value").cast("string").alias("value"))
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns]), WRITE_OPTIONS)
                     .alias("value"))


def publish(df: DataFrame, fmt: str = "kafka", options: dict | None = None,
            path: str | None = None, checkpoint: str | None = None, key: str = "campaign_id",
            available_now: bool = False):
    """S2 as a sink: write events as keyed JSON messages.

    A streaming ``df`` starts a streaming query (returned); a batch ``df`` is written once.
    Kafka takes ``kafka.bootstrap.servers`` / ``topic`` in ``options``; file formats and the
    message log (a stream writes every message to it once) take ``path``.
    """
    out = encode_events(df, key)
    opts = dict(options or {})
    if fmt == message_log.FORMAT:
        message_log.register(df.sparkSession)
    if df.isStreaming:
        w = out.writeStream.format(fmt).options(**opts)
        if available_now:
            w = w.trigger(availableNow=True)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.start(path) if path else w.start()
    w = out.write.format(fmt).options(**opts).mode("append")
    if path:
        w.save(path)
    else:
        w.save()
    return None


def wire_schema(schema: T.StructType = S.EVENT_SCHEMA) -> T.StructType:
    """Decode schema: time fields as zone-aware timestamps (messages carry offsets), plus
    the corrupt-record column."""
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType,
                                                                     T.TimestampNTZType)
                            else f.dataType) for f in schema.fields]
    return T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])


def _lower_keys(value: Column, names: list[str]) -> Column:
    """``value`` with its object keys spelled as in ``names``, whatever their case.

    Only documents with an upper-case letter in a key are rewritten; a quote inside a text
    value is escaped, so it cannot pass for a key.
    """
    out = value
    for n in names:
        out = F.regexp_replace(out, f'(?i)(?<!\\\\)"{n}"\\s*:', f'"{n}":')
    return F.when(value.rlike('(?<!\\\\)"[a-z_]*[A-Z][A-Za-z_]*"\\s*:'), out).otherwise(value)


def decode_events(df: DataFrame, schema: T.StructType = S.EVENT_SCHEMA,
                  value: str = "value") -> DataFrame:
    """Parse ``value`` into the event columns plus ``decode_error``.

    A message is rejected whole on broken JSON, a type mismatch (``1.5`` for a long), or a
    document that is not an object (``null``); unknown keys are ignored and the case of keys
    does not matter. Times are converted
    to the session time zone's wall clock (UTC in every job of this package).
    """
    ws = wire_schema(schema)
    parsed = F.from_json(_lower_keys(F.col(value), schema.fieldNames()), ws, {"mode": "PERMISSIVE",
                                           "columnNameOfCorruptRecord": CORRUPT,
                                           "timestampFormat": TIME_FORMAT})
    # Parse inside a one-element explode: filters on the parsed fields cannot be pushed below
    # a Generate, so Catalyst does not copy the parse into every pushed-down predicate.
    out = df.select("*", F.explode(F.array(parsed)).alias("_p"))
    error = (F.when(F.col(value).isNull(), F.lit("empty message"))
             .when(F.col("_p").isNull(), F.lit("not a JSON object"))
             .when(F.col(f"_p.{CORRUPT}").isNotNull(), F.lit("malformed JSON")))
    cols: list[Column] = []
    for f in schema.fields:
        c = F.col(f"_p.{f.name}")
        if isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast(T.TimestampNTZType())
        cols.append(F.when(error.isNull(), c).alias(f.name))
    keep = [F.col(c) for c in df.columns if c not in (value, "_p")]
    return out.select(*keep, *cols, error.alias("decode_error"), F.col(value).alias("raw_value"))


def decoded_ok(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("decode_error").isNull()).drop("decode_error", "raw_value")


"""Dimension tables: campaigns (S7), users (F7), platform credentials.

Dimensions are read with an explicit column list, so the Parquet scan reads only the columns
of the schema (the original read them with ``SELECT *``). The users table never carries its
password column past the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf import schemas as S

SENSITIVE_COLUMNS = ("password", "password_hash")


def _load(spark: SparkSession, path: str, fmt: str, options: dict | None) -> DataFrame:
    return spark.read.format(fmt).options(**(options or {})).load(path)


def conform(df: DataFrame, schema) -> DataFrame:
    """Select the schema's columns in order, cast to its types; absent columns are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])


def read_campaigns(spark: SparkSession, path: str, fmt: str = "parquet",
                   options: dict | None = None) -> DataFrame:
    """The campaign dimension."""
    return conform(_load(spark, path, fmt, options), S.CAMPAIGN_SCHEMA)


def drop_sensitive(df: DataFrame) -> DataFrame:
    """remove credential columns."""
    return df.drop(*[c for c in SENSITIVE_COLUMNS if c in df.columns])


def read_users(spark: SparkSession, path: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """users without their password."""
    return conform(drop_sensitive(_load(spark, path, fmt, options)), S.USER_SCHEMA)


def read_credentials(spark: SparkSession, path: str, fmt: str = "parquet",
                     options: dict | None = None) -> DataFrame:
    return conform(_load(spark, path, fmt, options), S.CREDENTIAL_SCHEMA)

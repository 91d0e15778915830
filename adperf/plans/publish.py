"""Fetch -> publish as one job: landed payload pages become keyed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adperf.sources import events as ev
from adperf.sources import payloads


def publish_landed(spark: SparkSession, landed: str, campaigns: DataFrame, fmt: str = "kafka",
                   options: dict | None = None, path: str | None = None,
                   multi_line: bool = False) -> DataFrame:
    """Read every landed page, flatten it through its platform's adapter, attach the campaign,
    and write the events as keyed JSON messages. Returns the rejects (unknown platform or
    campaign)."""
    pages = payloads.read_payloads(spark, landed, multi_line=multi_line)
    good, rejects = payloads.route_to_campaigns(payloads.adapt_pages(pages), campaigns)
    ev.publish(good, fmt=fmt, options=options, path=path)
    return rejects

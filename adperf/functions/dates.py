"""Date parameters and calendar buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from adperf import schemas as S

_TRUNC_UNIT = {"daily": None, "weekly": "week", "monthly": "month"}


def parse_day(value: str | dt.date | None, name: str = "date") -> dt.date | None:
    """Strict ``YYYY-MM-DD`` request parameter; anything else raises ``ValueError``."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value)
    if len(text) != 10:
        raise ValueError(f"invalid {name} format (use YYYY-MM-DD): {value!r}")
    try:
        return dt.date.fromisoformat(text)
    except ValueError as exc:
        raise ValueError(f"invalid {name} format (use YYYY-MM-DD): {value!r}") from exc


def default_range(start: str | dt.date | None, end: str | dt.date | None,
                  as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Missing start -> ``as_of - 30 days``, missing end -> ``as_of``; whole days, both ends in."""
    s = parse_day(start, "start_date")
    e = parse_day(end, "end_date")
    return (s or as_of - dt.timedelta(days=S.DEFAULT_RANGE_DAYS), e or as_of)


def check_granularity(granularity: str | None) -> str:
    g = granularity or "daily"
    if g not in _TRUNC_UNIT:
        raise ValueError(f"unknown granularity {granularity!r}; use one of {S.GRANULARITIES}")
    return g


def period_start(day: Column, granularity: str) -> Column:
    """First day of the period holding ``day``: the day, its ISO week (Monday), or its month."""
    unit = _TRUNC_UNIT[check_granularity(granularity)]
    return day if unit is None else F.date_trunc(unit, day).cast("date")


def ntz(value: dt.datetime | dt.date) -> Column:
    """A ``TIMESTAMP_NTZ`` literal that does not depend on any time zone.

    (``lit(datetime)`` makes a zone-aware timestamp from the Python process's local zone, and
    casting that to NTZ applies the session zone: the wall time would shift.)
    """
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def try_day(text: Column) -> Column:
    """Strict ``yyyy-MM-dd`` parse of a column; null when it does not parse."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))

"""Identifier and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adperf import schemas as S


def dedup_key(platform: Column, entity: Column, day: Column) -> Column:
    """``<platform>:<id>:<yyyy-MM-dd>`` - the key a platform adapter gives each daily row."""
    return F.concat_ws(":", platform, entity.cast("string"), F.date_format(day, "yyyy-MM-dd"))


def deterministic_uuid(*parts: Column) -> Column:
    """Name-based UUID text from ``parts`` (SHA-256, formatted 8-4-4-4-12).

    Used where the original generates a random id, so that a replay of the same input
    produces the same id.
    """
    h = F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def is_missing_id(c: Column) -> Column:
    """Missing identifier: null, empty, or the nil UUID (zero value of the original)."""
    as_text = c.cast("string")
    return c.isNull() | (as_text == "") | (as_text == S.NIL_UUID)

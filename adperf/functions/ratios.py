"""Guarded performance ratios.

Each ratio is ``numerator / denominator`` when the denominator is above zero, else ``0``. The
guard keeps the division legal under ANSI mode. Ratios are always computed from summed
counters, never averaged from finer ratios.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ratio name -> (numerator, denominator)
RATIO_DEFS = {
    "ctr": ("clicks", "impressions"),
    "cpc": ("spend", "clicks"),
    "cpa": ("spend", "conversions"),
    "roas": ("revenue", "spend"),
    "conversion_rate": ("conversions", "clicks"),
}


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double when ``den > 0``, else ``0.0``."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def ratio_columns(prefix: str = "") -> list[Column]:
    """The five ratios over columns named ``prefix + metric``."""
    return [safe_ratio(F.col(prefix + n), F.col(prefix + d)).alias(name)
            for name, (n, d) in RATIO_DEFS.items()]

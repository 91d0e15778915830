"""Running sums per key without a window over a whole key.

A window ordered inside a key puts all rows of the key into one task. Here the rows are put in
order by one range shuffle, whose partitions cut a heavy key into cells:

1. one sum per (key, cell), with map-side combine;
2. a scan over the cells of a key: at most as many rows as there are partitions;
3. a running frame inside each (key, cell), shifted by what the cells before it hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adperf.session import checkpoint_dir

CELL_BITS = 33  # monotonically_increasing_id: the partition is in the bits above


def in_order(df: DataFrame, order: list[str], at: str = "_at") -> DataFrame:
    """``df`` with ``at``, a number that increases with ``order``; rows that tie are told apart
    by where they were read, so copies of one row may lie in several partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "_copy"]
    laid = (df.withColumn("_copy", F.monotonically_increasing_id())
            .repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_copy")
            .withColumn(at, F.monotonically_increasing_id()))
    checkpoint_dir(df.sparkSession)
    return laid.checkpoint(eager=True)


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``key`` up to and
    including this one, by ``order``. Rows that tie are summed one after the other. ``key`` is
    not null; a null ``value`` adds nothing."""
    laid = in_order(df, [key, *order]).withColumn("_cell", F.shiftright("_at", CELL_BITS))
    zero = F.lit(0)
    sums = laid.groupBy(key, "_cell").agg(F.coalesce(F.sum(value), zero).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "_cell", F.coalesce(F.sum("_sum").over(earlier), zero)
                         .alias("_before"))
    inside = (Window.partitionBy(key, "_cell").orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (laid.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
            .join(before, [key, "_cell"])
            .withColumn(out, F.col("_before") + F.col("_inside"))
            .select(*df.columns, out))

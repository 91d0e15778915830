"""The stored insights laid out by campaign and time at once.

The insight table lies by day, so a request for a few campaigns over a long range opens every
day. :func:`cluster_insights` writes a copy in a space-filling order: campaigns (by a hash, since
requests name them) and days are cut into ``2 ** BITS`` cells of about equal row counts, the bits
of both cells are interleaved, and the rows are range-partitioned by the result; a task writes its
range as one file after the other. A file then holds
a small rectangle of campaigns and days, and its footers a Bloom filter of its campaigns. Beside
the files lies an index, one row a file with the bounds of its rectangle.

:func:`read_clustered` opens the files whose rectangle meets the request, and no other. The copy
is never stale: it knows which files of each day it was made from, and days written since (a
refresh, late events) are read from the day table. A copy becomes current by one small rename;
readers see the earlier one until then.

Skew: cells come from quantiles, so a campaign with a third of all rows spans many cells by its
days, and rows of one cell are spread by a hash. To the driver come the quantiles
(``2 ** BITS`` a column), folder and file names, and the index rows a request meets. A request of
many campaigns comes as a table, which is joined and never collected.

Edge cases: rows without a campaign are in the first cell and meet no request that names one; rows
without a day stay in the day table alone; days that were deleted since are not read; without a
copy all is read from the day table; an empty table gives an empty copy.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.sources import journal, storage

CLUSTERED = "insights_clustered"
BITS = 8
ACCURACY = 16 << BITS  # of the quantiles: a sixteenth of a cell
ROWS_PER_FILE = 4_000_000
ROWS_PER_TASK = 100_000  # a task writes several files where they are smaller than this
RANGES = 16  # bits: a table of campaigns is looked up in the index as at most 2 ** RANGES ranges
INDEX_SCHEMA = "file string, n long, lo long, hi long, day_lo date, day_hi date"


def _campaign(value: Column) -> Column:
    """A campaign's place on the first axis."""
    return F.when(value.isNotNull(), F.xxhash64(value.cast("string")))


def _cell(value: Column, bounds: list, bits: int) -> Column:
    """How many of the ``2 ** bits - 1`` sorted ``bounds`` are at or below ``value``."""
    at = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(
        steps, F.lit(0), lambda n, s: n + F.when(value >= F.element_at(at, n + s), s)
        .otherwise(F.lit(0))))


def _interleaved(a: Column, b: Column, bits: int) -> Column:
    out = F.lit(0)
    for i in range(bits):
        out = (out + F.shiftleft(F.shiftright(a, i).bitwiseAND(F.lit(1)), 2 * i + 1)
               + F.shiftleft(F.shiftright(b, i).bitwiseAND(F.lit(1)), 2 * i))
    return out


def space_filling(df: DataFrame, one: Column, two: Column, bits: int = BITS,
                  name: str = "place") -> DataFrame:
    """``df`` and a column ``name``: the place of (``one``, ``two``), both whole numbers, on a
    Z-shaped curve over cells of about equal row counts."""
    shares = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    row = df.agg(F.percentile_approx(one, shares, ACCURACY).alias("a"),
                 F.percentile_approx(two, shares, ACCURACY).alias("b")).first()
    none = [0] * ((1 << bits) - 1)  # no value at all: any bounds do
    cells = df.withColumns({"_one": _cell(one, row.a or none, bits),
                            "_two": _cell(two, row.b or none, bits)})
    return cells.withColumn(name, _interleaved(F.col("_one"), F.col("_two"), bits)).drop(
        "_one", "_two")


def _day_files(spark: SparkSession, root: str, days: list[str]) -> dict[str, list[str]]:
    """The names of the files of each day of the insight table: a rewritten day has others."""
    folders = storage.day_folders(spark, root, storage.INSIGHTS)
    days = [d for d in days if d in folders]

    def names(day: str) -> list[str]:
        listed = journal.children(spark, os.path.join(root, storage.INSIGHTS, folders[day]))
        return sorted(f for f in listed if f.startswith("part-"))

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(days, pool.map(names, days)))


def _current(spark: SparkSession, root: str) -> dict | None:
    text = journal.read_text(spark, os.path.join(root, CLUSTERED, "current.json"))
    return json.loads(text) if text else None


def cluster_insights(spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE,
                     bits: int = BITS) -> dict:
    """Write a clustered copy of the stored insights and make it current; the copy before it is
    deleted. Returns its ``version``, ``files`` and ``rows``. Nothing may read the copy before it
    for longer than this job takes."""
    base, before = os.path.join(root, CLUSTERED), _current(spark, root)
    days = _day_files(spark, root, [d for d in storage.day_folders(spark, root, storage.INSIGHTS)
                                    if d != storage.NO_DAY])
    version = uuid.uuid4().hex
    path = os.path.join(base, f"version={version}")
    source = storage._read_paths(spark, root, storage.INSIGHTS, days, S.INSIGHT_SCHEMA)
    n = source.count()
    placed = space_filling(source, _campaign(F.col("campaign_id")), F.unix_date("date"), bits)
    spread = F.xxhash64(*source.columns)
    tasks = max(1, -(-n // max(rows_per_file, ROWS_PER_TASK)))
    (placed.repartitionByRange(tasks, "place", spread)
     .sortWithinPartitions("place", *S.INSIGHT_KEY).drop("place")
     .write.option("maxRecordsPerFile", rows_per_file)
     .option("parquet.bloom.filter.enabled#campaign_id", "true")
     .option("parquet.bloom.filter.expected.ndv#campaign_id", str(min(rows_per_file, 1 << 17)))
     .parquet(os.path.join(path, "rows")))
    written = spark.read.schema(source.schema).parquet(os.path.join(path, "rows"))
    key = _campaign(F.col("campaign_id"))
    index = (written.select(F.col("_metadata.file_name").alias("file"), key.alias("key"), "date")
             .groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"),
                                  F.max("key").alias("hi"), F.min("date").alias("day_lo"),
                                  F.max("date").alias("day_hi")))
    index.coalesce(1).write.parquet(os.path.join(path, "files"))
    journal.write_text(spark, os.path.join(path, "days.json"), json.dumps(days))
    journal.write_text(spark, os.path.join(base, "current.json"),
                       json.dumps({"version": version, "schema": source.schema.jsonValue()}))
    if before:
        journal.delete(spark, os.path.join(base, f"version={before['version']}"))
    return {"version": version, "files": len(files_for(spark, root)[0]), "rows": n}


def _ranges(campaigns: DataFrame) -> DataFrame:
    """A table of campaigns as ranges of their places (first, last), a bounded number of them."""
    keys = campaigns.select(_campaign(F.col("campaign_id")).alias("key")).where("key IS NOT NULL")
    return keys.groupBy(F.shiftright("key", 64 - RANGES)).agg(
        F.min("key").alias("first"), F.max("key").alias("last")).select("first", "last")


def files_for(spark: SparkSession, root: str, campaigns: list | DataFrame | None = None,
              start: dt.date | None = None, end: dt.date | None = None) -> tuple[list[str], int]:
    """The files of the current copy that a request has to open, and how many there are.

    A table of campaigns is met by ranges, so a file between two campaigns of one range may be
    opened in vain.
    """
    now = _current(spark, root)
    if now is None:
        return [], 0
    path = os.path.join(root, CLUSTERED, f"version={now['version']}")
    index = spark.read.schema(INDEX_SCHEMA).parquet(os.path.join(path, "files"))
    meets, asked = F.lit(True), index
    if isinstance(campaigns, DataFrame):
        asked = index.join(F.broadcast(_ranges(campaigns)), (F.col("lo") <= F.col("last"))
                           & (F.col("hi") >= F.col("first")), "left_semi")
    elif campaigns is not None:
        wanted = F.array(*[_campaign(F.lit(c)) for c in campaigns])
        meets &= F.exists(wanted, lambda c: c.between(F.col("lo"), F.col("hi")))
    if start is not None:
        meets &= F.col("day_hi") >= F.lit(start)
    if end is not None:
        meets &= F.col("day_lo") <= F.lit(end)
    found = [r.file for r in asked.where(meets).select("file").collect()]  # names of files
    return [os.path.join(path, "rows", f) for f in sorted(found)], index.count()


def read_clustered(spark: SparkSession, root: str, campaigns: list | DataFrame | None = None,
                   start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """S6 with F1's campaign and range filters: the same rows as the day table gives.

    ``campaigns`` is the request's list, or a table with a column ``campaign_id`` where it names
    many (it is joined with the rows); None asks for all.
    """
    known = storage.day_folders(spark, root, storage.INSIGHTS)
    asked = storage._days_between(known, start, end, None)
    now, there = _current(spark, root), {}
    if now is not None:
        there = json.loads(journal.read_text(
            spark, os.path.join(root, CLUSTERED, f"version={now['version']}", "days.json")))
    files = _day_files(spark, root, asked)
    fresh = {d for d in asked if d in there and files.get(d) == there[d]}
    stale = {d: f for d, f in files.items() if d not in fresh}
    rows = storage._read_paths(spark, root, storage.INSIGHTS, stale, S.INSIGHT_SCHEMA)
    if fresh:
        paths, _ = files_for(spark, root, campaigns, start, end)
        schema = T.StructType.fromJson(now["schema"])
        kept = (spark.read.schema(schema).parquet(*paths) if paths
                else spark.createDataFrame([], schema))
        gone = [dt.date.fromisoformat(d) for d in storage._days_between(there, start, end, None)
                if d not in fresh]  # written again or deleted since
        if gone:
            kept = kept.filter(~F.col("date").isin(gone))
        rows = (kept.unionByName(rows.select(*schema.fieldNames()))
                if any(stale.values()) else kept)
    if isinstance(campaigns, DataFrame):
        rows = rows.join(campaigns.select("campaign_id").distinct(), "campaign_id", "left_semi")
    elif campaigns is not None:
        rows = rows.filter(F.col("campaign_id").isin(list(campaigns)))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end))
    return rows

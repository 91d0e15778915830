"""Partitioned Parquet storage of facts (S3, S5) and insights (S4, S6); table creation.

Layout under a root folder (a shared file system or object store on a cluster):

- ``facts/event_date=YYYY-MM-DD/ingest_batch=<id>/run=<run>/`` - appended facts, day first, so a
  reader of some days lists those days only. Every run of a batch has folders of its own; the
  journal (:mod:`adperf.sources.journal`) says which run counts. Last-wins on the fact key is
  applied when facts are read for roll-ups.
- ``rejects/ingest_batch=<id>/run=<run>/`` - rejected events with their reason.
- ``dedup_state/state_day=YYYY-MM-DD/ingest_batch=<id>/run=<run>/`` - keys a run accepted and its
  arrival stamp, in ``STATE_BUCKETS`` buckets by the key's hash: a join by key shuffles the batch
  that asks, never the state. Only the days of one TTL window are ever read back.
- ``insights/day=YYYY-MM-DD/`` - daily insights; a refresh replaces whole days, recomputed from
  the facts that count.
- ``insight_deltas/event_date=YYYY-MM-DD/generation=<n>/ingest_batch=<id>/run=<run>/`` - what each
  run adds to and takes from the daily sums, for stores that keep deltas in place of the table
  above (:mod:`adperf.plans.deltas`). A day is the sum of its highest generation.
- ``facts/_schema.json`` - the schema of the facts, so that no reader infers it from footers.

Writes use a ``rebalance`` hint on the partition column, so AQE sizes the output tasks (and
splits a day that holds most of the data) instead of one task per day or one file per task and
partition. Rows are sorted by the table key inside each file, so Parquet row-group min/max
statistics skip data for campaign and time predicates. A write goes through a staging folder of
its own (dynamic overwrite of folders nobody else has), so jobs that run at once do not meet.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import ntz
from adperf.sources import journal
from adperf.sources.journal import Record

FACTS = "facts"
INSIGHTS = "insights"
REJECTS = "rejects"
DEDUP_STATE = "dedup_state"
DELTAS = "insight_deltas"
#: buckets of the dedup state: the number of tasks that eight days of keys are read by
STATE_BUCKETS = 32
RUN_PARTS = [T.StructField("ingest_batch", T.StringType()), T.StructField("run", T.StringType())]
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder name for null


def _overwrite(df: DataFrame, path: str, partition_cols: list[str], sort_cols: list[str],
               in_stream: bool = False, as_dealt: bool = False):
    """Overwrite the partitions present in ``df``.

    Batch jobs use the ``rebalance`` hint (AQE sizes the tasks); rows of one single partition
    would all be dealt to one task by it, so they are written by the tasks that hold them
    (``as_dealt``). Inside a streaming
    micro-batch AQE is off and the hint is ignored, so the rows are range-partitioned on
    (partition columns, key) instead: each task writes a contiguous slice - few files per
    partition - and a large partition still spreads over several tasks.
    """
    if in_stream:
        # the hash spreads rows that share all other columns (malformed messages do)
        spread = F.xxhash64(*df.columns)
        laid = df.repartitionByRange(*partition_cols, *sort_cols, spread)
    else:
        laid = df if as_dealt else df.hint("rebalance", *partition_cols)
    (laid.sortWithinPartitions(*partition_cols, *sort_cols).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_cols)
         .parquet(path))


def _write_run(df: DataFrame, root: str, name: str, record: Record, day: str | None,
               sort_cols: list[str], in_stream: bool) -> None:
    df = df.withColumns({"ingest_batch": F.lit(record.batch), "run": F.lit(record.run)})
    _overwrite(df, os.path.join(root, name), [*([day] if day else []), "ingest_batch", "run"],
               sort_cols, in_stream, as_dealt=day is None)


def _run_path(root: str, name: str, day: str | None, batch: str, run: str) -> str:
    return os.path.join(root, name, *([day] if day else []), f"ingest_batch={batch}", f"run={run}")


def day_folders(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    """Day folders of a table: value (a day, or ``NO_DAY``) to folder name."""
    return {f.split("=", 1)[1]: f for f in journal.children(spark, os.path.join(root, name))
            if "=" in f}


def _run_days(spark: SparkSession, root: str, name: str, batch: str, run: str) -> list[str]:
    """Days (as folder values) for which a run wrote something: one look per day folder."""
    folders = day_folders(spark, root, name)
    with ThreadPoolExecutor(16) as pool:
        there = pool.map(lambda f: journal.exists(spark, _run_path(root, name, f, batch, run)),
                         folders.values())
        return [day for day, found in zip(folders, there) if found]


def run_days(spark: SparkSession, root: str, record: Record) -> list[dt.date]:
    """Days for which a run wrote facts, switched or not."""
    return [dt.date.fromisoformat(d)
            for d in _run_days(spark, root, FACTS, record.batch, record.run) if d != NO_DAY]


def _delete_run(spark: SparkSession, root: str, batch: str, run: str,
                fact_days: list[str] | None = None) -> None:
    """Delete all that a run wrote, and batch and day folders that are empty then."""
    if fact_days is None:
        fact_days = _run_days(spark, root, FACTS, batch, run)
    state_days = _run_days(spark, root, DEDUP_STATE, batch, run)
    gone = [_run_path(root, FACTS, f"event_date={d}", batch, run) for d in fact_days]
    gone += [_run_path(root, DEDUP_STATE, f"state_day={d}", batch, run) for d in state_days]
    _drop(spark, gone)
    journal.delete(spark, _run_path(root, REJECTS, None, batch, run))


def _drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete run folders, and the two levels above them where nothing is left there."""
    for path in paths:
        journal.delete(spark, path)
        for _ in range(2):
            path = os.path.dirname(path)
            if not journal.children(spark, path):
                journal.delete(spark, path)


# ---- schema -------------------------------------------------------------------------------

def _fact_schema(spark: SparkSession, root: str) -> T.StructType | None:
    text = journal.read_text(spark, os.path.join(root, FACTS, "_schema.json"))
    return T.StructType.fromJson(json.loads(text)) if text else None


def _note_schema(facts: DataFrame, root: str) -> None:
    spark, known = facts.sparkSession, _fact_schema(facts.sparkSession, root)
    if known is None:
        journal.write_text(spark, os.path.join(root, FACTS, "_schema.json"), facts.schema.json())
    elif known.simpleString() != facts.schema.simpleString():
        raise ValueError(f"the store holds facts of {known.simpleString()}, "
                         f"not of {facts.schema.simpleString()}")


# ---- one run of a batch -------------------------------------------------------------------

def write_run_facts(facts: DataFrame, root: str, record: Record, in_stream: bool = False) -> None:
    """S3: the facts of a run that is not switched yet."""
    facts = facts.select(*[c for c in S.EVENT_SCHEMA.fieldNames() if c in facts.columns])
    _note_schema(facts, root)
    _write_run(facts.withColumn("event_date", F.to_date("event_time")), root, FACTS, record,
               "event_date", list(S.FACT_KEY), in_stream)


def write_run_rejects(rejects: DataFrame, root: str, record: Record,
                      in_stream: bool = False) -> None:
    _write_run(rejects, root, REJECTS, record, None,
               ["id"] if "id" in rejects.columns else [], in_stream)


def switch_run(spark: SparkSession, root: str, record: Record) -> Record:
    """Make the run the one that counts: one small write, all or nothing."""
    days = _run_days(spark, root, FACTS, record.batch, record.run)
    return journal.switch(spark, root, record, days)


def undo_run(spark: SparkSession, root: str, record: Record) -> None:
    """Forget a run that is not switched: no reader has seen any of it."""
    _delete_run(spark, root, record.batch, record.run)
    if record.kind != "table":
        drop_run_deltas(spark, root, record)
    journal.close(spark, root, record)


def finish_run(spark: SparkSession, root: str, record: Record) -> None:
    """Point the batch to its switched run, delete what it replaces, close the record. May be
    repeated at any point."""
    if record.kind != "table":
        drop_old_generations(spark, root, sorted({*record.days, *record.old_days}))
    if record.kind != "compact":
        journal.point(spark, root, record)
    if record.old_run:
        _delete_run(spark, root, record.batch, record.old_run, record.old_days)
    journal.close(spark, root, record)


def changed_days(record: Record) -> list[dt.date]:
    """Days whose insights a switched run changes: its own, and those of the run it replaces."""
    return sorted(dt.date.fromisoformat(d) for d in {*record.days, *record.old_days}
                  if d != NO_DAY)


def write_facts(facts: DataFrame, root: str, batch_id: str | int,
                in_stream: bool = False) -> list[dt.date]:
    """S3: store a batch of facts by itself, replacing all that an earlier run of the id stored.
    Returns the days that either touches, whose insights the caller refreshes; the ingest jobs
    keep the record open until that is done."""
    spark = facts.sparkSession
    record = journal.begin(spark, root, batch_id)
    write_run_facts(facts, root, record, in_stream)
    record = switch_run(spark, root, record)
    finish_run(spark, root, record)
    return changed_days(record)


# ---- facts --------------------------------------------------------------------------------

def _read_days(spark: SparkSession, root: str, name: str, schema: T.StructType, column: str,
               wanted: list[str], as_if: Record | None = None) -> DataFrame:
    """Rows that count, of the day folders ``wanted`` alone: other days are not even listed."""
    base = os.path.join(root, name)
    full = T.StructType([*schema.fields, T.StructField(column, T.DateType()), *RUN_PARTS])
    if not wanted:
        return spark.createDataFrame([], full)
    df = (spark.read.schema(full).option("basePath", base)
          .parquet(*[os.path.join(base, f"{column}={d}") for d in wanted]))
    hidden = set(journal.hidden_runs(spark, root))
    if as_if is not None:
        hidden = (hidden - {as_if.run}) | {as_if.old_run} - {None}
    return df.filter(~F.col("run").isin(sorted(hidden))) if hidden else df


def fact_days(spark: SparkSession, root: str) -> list[dt.date]:
    """Days that have a folder of facts."""
    return [dt.date.fromisoformat(d) for d in day_folders(spark, root, FACTS) if d != NO_DAY]


def live_days(spark: SparkSession, root: str, days: list[dt.date]) -> list[dt.date]:
    """Those of ``days`` that hold facts that count."""
    hidden, out = set(journal.hidden_runs(spark, root)), []
    known = day_folders(spark, root, FACTS)
    for day in days:
        folder = os.path.join(root, FACTS, known.get(day.isoformat(), ""))
        if day.isoformat() in known and any(
                set(journal.children(spark, os.path.join(folder, b)))
                - {f"run={r}" for r in hidden} for b in journal.children(spark, folder)):
            out.append(day)
    return out


def _days_between(known: dict[str, str], start: dt.date | None, end: dt.date | None,
                  days: list[dt.date] | None) -> list[str]:
    wanted = set(known) if days is None else {d.isoformat() for d in days} & set(known)
    if start is not None:
        wanted = {d for d in wanted if d != NO_DAY and d >= start.isoformat()}
    if end is not None:
        wanted = {d for d in wanted if d != NO_DAY and d <= end.isoformat()}
    return sorted(wanted)


def read_facts(spark: SparkSession, root: str, start: dt.date | None = None,
               end: dt.date | None = None, days: list[dt.date] | None = None,
               schema=S.EVENT_SCHEMA, as_if: Record | None = None) -> DataFrame:
    """Facts of the whole days ``start..end`` and/or of ``days``; other days are not listed.

    An absent table reads as empty with ``schema``. ``as_if`` names a run under way that is read
    as if it were switched already.
    """
    wanted = _days_between(day_folders(spark, root, FACTS), start, end, days)
    found = _fact_schema(spark, root) or schema
    return _read_days(spark, root, FACTS, found, "event_date", wanted, as_if).select(
        *found.fieldNames())


def _read_run(spark: SparkSession, root: str, batch: str, run: str,
              days: list[str]) -> DataFrame | None:
    paths = [_run_path(root, FACTS, f"event_date={d}", batch, run) for d in days]
    return spark.read.schema(_fact_schema(spark, root)).parquet(*paths) if paths else None


def read_run(spark: SparkSession, root: str, record: Record) -> DataFrame | None:
    """The facts that a run wrote, switched or not; None when it wrote none."""
    days = record.days if record.switched else _run_days(spark, root, FACTS, record.batch,
                                                         record.run)
    return _read_run(spark, root, record.batch, record.run, days)


def read_batch(spark: SparkSession, root: str, batch_id: str | int) -> DataFrame | None:
    """The facts that a finished batch stored; None when it stored none."""
    batch = journal.batch_name(batch_id)
    found = journal.pointer(spark, root, batch)
    kept = day_folders(spark, root, FACTS)  # retention may have taken some
    return _read_run(spark, root, batch, found["run"],
                     [d for d in found["days"] if d in kept]) if found else None


# ---- insights -----------------------------------------------------------------------------

def write_insights(insights: DataFrame, root: str, in_stream: bool = False) -> None:
    """Replace the days present in ``insights``, which must hold every row of them."""
    _overwrite(insights.withColumn("day", F.col("date")), os.path.join(root, INSIGHTS), ["day"],
               list(S.INSIGHT_KEY), in_stream)


def empty_insights(spark: SparkSession, root: str, days: list[dt.date]) -> None:
    """Leave no insight row of ``days``."""
    for day in days:
        journal.delete(spark, os.path.join(root, INSIGHTS, f"day={day.isoformat()}"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        # absent, or without any row yet
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def _read_paths(spark: SparkSession, root: str, name: str, days: dict[str, list[str]],
                schema: T.StructType) -> DataFrame:
    """Rows of the day folders ``days`` of a table, its own schema where it has any row."""
    folders = day_folders(spark, root, name)
    paths = [os.path.join(root, name, folders[d]) for d, files in days.items() if files]
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_insights(spark: SparkSession, root: str, start: dt.date | None = None,
                  end: dt.date | None = None, schema=S.INSIGHT_SCHEMA) -> DataFrame | None:
    """The insight table, whole days ``start..end`` only (partition pruned).

    An absent table reads as empty with ``schema``, or as ``None`` when ``schema`` is None.
    """
    df = _read(spark, os.path.join(root, INSIGHTS))
    if df is None:
        return None if schema is None else spark.createDataFrame([], schema)
    if start is not None:
        df = df.filter(F.col("day") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("day") <= F.lit(end))
    return df.drop("day")


# ---- insight deltas -----------------------------------------------------------------------

def generations(spark: SparkSession, root: str, day: str) -> dict[int, set[str]]:
    """Generations of a day's deltas that count, with their runs."""
    hidden, out = set(journal.hidden_runs(spark, root)), {}
    base = os.path.join(root, DELTAS, f"event_date={day}")
    for g in journal.children(spark, base):
        runs = {r.split("=", 1)[1] for b in journal.children(spark, os.path.join(base, g))
                for r in journal.children(spark, os.path.join(base, g, b))} - hidden
        if runs:
            out[int(g.split("=", 1)[1])] = runs
    return out


def delta_days(spark: SparkSession, root: str, start: dt.date | None = None,
               end: dt.date | None = None, days: list[dt.date] | None = None) -> dict[str, int]:
    """Days that hold deltas, with the generation that counts."""
    wanted = _days_between(day_folders(spark, root, DELTAS), start, end, days)
    with ThreadPoolExecutor(16) as pool:
        found = pool.map(lambda d: max(generations(spark, root, d), default=-1), wanted)
        return {d: g for d, g in zip(wanted, found) if g >= 0}


def write_run_deltas(deltas: DataFrame, root: str, record: Record,
                     in_stream: bool = False) -> None:
    """Deltas of a run (insight key, sums, ``n_facts``, ``generation``)."""
    df = deltas.withColumns({"event_date": F.col("date"), "ingest_batch": F.lit(record.batch),
                             "run": F.lit(record.run)})
    if journal.read_text(df.sparkSession, os.path.join(root, DELTAS, "_schema.json")) is None:
        journal.write_text(df.sparkSession, os.path.join(root, DELTAS, "_schema.json"),
                           deltas.drop("generation").schema.json())
    _overwrite(df, os.path.join(root, DELTAS),
               ["event_date", "generation", "ingest_batch", "run"], list(S.INSIGHT_KEY), in_stream)


def read_deltas(spark: SparkSession, root: str, counted: dict[str, int]) -> DataFrame | None:
    """Delta rows of the days and generations ``counted`` (from :func:`delta_days`)."""
    text = journal.read_text(spark, os.path.join(root, DELTAS, "_schema.json"))
    if text is None:
        return None
    schema = T.StructType.fromJson(json.loads(text))
    if not counted:
        return spark.createDataFrame([], schema)
    base = os.path.join(root, DELTAS)
    df = (spark.read.schema(T.StructType([*schema.fields, T.StructField(
            "generation", T.IntegerType()), *RUN_PARTS])).option("basePath", base)
          .parquet(*[os.path.join(base, f"event_date={d}", f"generation={g}")
                     for d, g in counted.items()]))
    hidden = journal.hidden_runs(spark, root)
    return (df.filter(~F.col("run").isin(hidden)) if hidden else df).select(*schema.fieldNames())


def drop_old_generations(spark: SparkSession, root: str, days: list[str]) -> None:
    """Delete the generations of ``days`` below the one that counts."""
    for day in days:
        base = os.path.join(root, DELTAS, f"event_date={day}")
        top = max(generations(spark, root, day), default=-1)
        for g in journal.children(spark, base):
            if int(g.split("=", 1)[1]) < top:
                journal.delete(spark, os.path.join(base, g))


def drop_run_deltas(spark: SparkSession, root: str, record: Record) -> None:
    """Delete the deltas of a run that is not switched."""
    for folder in day_folders(spark, root, DELTAS).values():
        base = os.path.join(root, DELTAS, folder)
        _drop(spark, [path for g in journal.children(spark, base) if journal.exists(
            spark, path := os.path.join(base, g, f"ingest_batch={record.batch}",
                                        f"run={record.run}"))])


# ---- dedup state --------------------------------------------------------------------------

def _state_table(spark: SparkSession, root: str, key: str) -> str:
    """The catalog's name for the bucketed state of a store; created where it is absent."""
    name = "adperf_state_" + hashlib.sha256(root.encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        buckets = journal.read_text(spark, os.path.join(root, DEDUP_STATE, "_buckets"))
        if buckets is None:  # fixed when the state is first written
            buckets = str(STATE_BUCKETS)
            journal.write_text(spark, os.path.join(root, DEDUP_STATE, "_buckets"), buckets)
        spark.sql(f"CREATE TABLE {name} (`{key}` STRING, accepted_at TIMESTAMP_NTZ, "
                  "state_day DATE, ingest_batch STRING, run STRING) USING parquet "
                  "PARTITIONED BY (state_day, ingest_batch, run) "
                  f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS "
                  f"LOCATION '{os.path.join(root, DEDUP_STATE)}'")
    return name


def state_buckets(spark: SparkSession, root: str) -> int:
    text = journal.read_text(spark, os.path.join(root, DEDUP_STATE, "_buckets"))
    return int(text) if text else STATE_BUCKETS


def _state_runs(spark: SparkSession, root: str, since: dt.date) -> set[tuple[str, str, str]]:
    """(state_day, ingest_batch, run) folders from ``since`` on, without hidden runs."""
    hidden, out = set(journal.hidden_runs(spark, root)), set()
    for day, folder in day_folders(spark, root, DEDUP_STATE).items():
        if day >= since.isoformat():
            base = os.path.join(root, DEDUP_STATE, folder)
            out |= {(day, b.split("=", 1)[1], r.split("=", 1)[1])
                    for b in journal.children(spark, base)
                    for r in journal.children(spark, os.path.join(base, b))}
    return {x for x in out if x[2] not in hidden}


def write_run_state(accepted: DataFrame, root: str, record: Record, arrived: dt.datetime,
                    key: str = "deduplication_key") -> None:
    """Keys that a run accepted, stamped with its arrival, one file a bucket."""
    spark = accepted.sparkSession
    table = _state_table(spark, root, key)
    out = (accepted.filter(F.col(key).isNotNull()).select(key).distinct()
           .repartition(state_buckets(spark, root), key)
           .select(key, ntz(arrived).alias("accepted_at")))
    where = _state_spec((arrived.date().isoformat(), record.batch, record.run))
    spark.sql(f"INSERT OVERWRITE {table} {where} SELECT * FROM {{out}}", out=out)


def _state_spec(x: tuple[str, str, str]) -> str:
    return f"PARTITION (state_day=DATE'{x[0]}', ingest_batch='{x[1]}', run='{x[2]}')"


def read_dedup_state(spark: SparkSession, root: str, arrived: dt.datetime, batch_id: str | int,
                     key: str = "deduplication_key") -> DataFrame | None:
    """``(key, accepted_at)`` entries of one TTL window before ``arrived``, but for the batch's
    own (a replay must not see its first attempt). None when there is no state yet.

    The rows come from a bucketed table: a join on ``key`` with :func:`state_buckets` partitions
    on the other side shuffles none of them.
    """
    since = (arrived - dt.timedelta(days=S.DEDUP_TTL_DAYS)).date()
    own = journal.batch_name(batch_id)
    runs = {x for x in _state_runs(spark, root, since) if x[1] != own}
    if not runs:
        return None
    table = _state_table(spark, root, key)
    # what other sessions wrote or deleted meanwhile
    known = {tuple(p.split("=", 1)[1] for p in r[0].split("/"))
             for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}

    if missing := runs - known:
        added = " ".join(map(_state_spec, sorted(missing)))
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
    if lost := {x for x in known - runs if x[1] != own}:
        dropped = ", ".join(map(_state_spec, sorted(lost)))
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {dropped}")
    return (spark.table(table).filter((F.col("state_day") >= F.lit(since))
                                      & (F.col("ingest_batch") != F.lit(own)))
            .select(key, "accepted_at"))


# ---- tables -------------------------------------------------------------------------------

def ensure_tables(spark: SparkSession, root: str, fact_schema=S.EVENT_SCHEMA,
                  insight_schema=S.INSIGHT_SCHEMA, database: str = "adperf") -> list[str]:
    """Create the fact and insight tables with their schemas and partition columns when
    absent (idempotent); returns their names."""
    def ddl(fields) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for name, schema, parts in (
            (FACTS, fact_schema, "`event_date` date, `ingest_batch` string, `run` string"),
            (INSIGHTS, insight_schema, "`day` date")):
        columns = ", ".join(p.split("` ")[0].strip() + "`" for p in parts.split(", "))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl(schema.fields)}, {parts}) "
                  f"USING parquet PARTITIONED BY ({columns}) "
                  f"LOCATION '{os.path.join(root, name)}'")
        names.append(f"{database}.{name}")
    return names


def register_tables(spark: SparkSession, root: str, database: str = "adperf") -> list[str]:
    """Expose the stored tables to Spark SQL as external Parquet tables
    (``<database>.facts``, ``.insights``, ``.rejects``), partitions discovered from the folders.
    A run that is under way shows its files there; :func:`read_facts` leaves them out.
    Idempotent; returns the registered names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for name in (FACTS, INSIGHTS, REJECTS):
        path = os.path.join(root, name)
        if _read(spark, path) is None:
            continue
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full):
            spark.catalog.createTable(full, path=path, source="parquet")
        spark.catalog.recoverPartitions(full)
        names.append(full)
    return names

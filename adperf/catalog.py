"""Registered queries over the driver tables: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads whole driver tables (through the adapter views of
:mod:`adperf.sources.tables`) and runs one operator of the inventory on them. Output columns
are named exactly as in :mod:`adperf.oracle`, which holds the equivalent DuckDB SQL.
Timestamps that would be wall-clock (``received_at``, ``processed_at``, ``updated_at``) are
left out of checked outputs or pinned to data columns.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.functions.dates import ntz, try_day
from adperf.operators import budget, campaigns, dedup, insights, quality, rollup, validate
from adperf.plans import cluster, deltas, fetch, publish, refresh, request, retention
from adperf.plans import ingest as ingest_job
from adperf.plans import reaggregate as reaggregate_job
from adperf.session import checkpoint_dir
from adperf.sources import events as ev
from adperf.sources import dimensions, journal, message_log, payloads, storage, tables
from adperf.streaming import ingest, windows

# Parameters of the registered queries (fixed so the oracle can repeat them).
FILTER_START = dt.date(2024, 1, 8)
FILTER_END = dt.date(2024, 1, 21)
FILTER_PLATFORM = "google"
FILTER_REGION = "AMERICA"
INSIGHTS_AS_OF = dt.date(2024, 1, 25)
STALE_CUT = dt.datetime(2024, 1, 15, 12, 0, 0)
REAGG_START = dt.date(2024, 1, 10)
REAGG_END = dt.date(2024, 1, 20)
INCREMENT_CUTS = (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
SNAPSHOT_CUT = dt.datetime(1998, 1, 1)
FETCH_AS_OF = dt.date(1997, 1, 1)
EVENTS_AS_OF = dt.date(2024, 1, 30)

CLUSTER_USER = 7

LAST_WINS_KEY = ("platform", "campaign_id", "event_type", "day")
TTL_KEY = ("platform", "campaign_id", "event_type")

EVENT_OUT = ("id", "campaign_id", "platform", "event_type", "impressions", "clicks",
             "conversions", "spend", "revenue", "event_time", "region", "currency",
             "deduplication_key")
INSIGHT_OUT = S.INSIGHT_COLUMNS


def _event_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in S.AMOUNTS else F.col(c)
                       for c in EVENT_OUT])


def validated_events(spark: SparkSession, sf_dir: str,
                     key_parts: tuple[str, ...] = LAST_WINS_KEY) -> DataFrame:
    """Raw driver events through P2-P7 (``reject_reason`` kept), replayable stamps."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), key_parts)
    return validate.validate(raw, now=F.col("received_at"), processed_at=F.col("processed_at"))


def accepted_events(spark: SparkSession, sf_dir: str,
                    key_parts: tuple[str, ...] = LAST_WINS_KEY) -> DataFrame:
    return validate.accepted(validated_events(spark, sf_dir, key_parts))


# ---- P2-P7 -------------------------------------------------------------------------------

def q_validate_accept(spark, sf_dir):
    return _event_out(accepted_events(spark, sf_dir))


def q_validate_rejects(spark, sf_dir):
    return validate.rejected(validated_events(spark, sf_dir)).select(
        "id", "campaign_id", "event_type", "event_time", "reject_reason")


# ---- D1-D3 -------------------------------------------------------------------------------

def q_dedup_last(spark, sf_dir):
    facts = accepted_events(spark, sf_dir, LAST_WINS_KEY)
    return _event_out(dedup.last_wins(facts, ["deduplication_key"], ["processed_at", "id"]))


def q_dedup_first_ttl(spark, sf_dir):
    facts = accepted_events(spark, sf_dir, TTL_KEY)
    return _event_out(dedup.first_wins_ttl(facts, "deduplication_key", "received_at"))


def _ts(v: dt.datetime):
    return ntz(v)


def q_insights_latest(spark, sf_dir):
    """D3 over two stored versions: a stale load (events before a cut, stamped at the cut)
    and a full recompute (stamped at the last event); the latest version of each key wins."""
    facts = accepted_events(spark, sf_dir)
    stale = rollup.insights_of(facts.filter(F.col("event_time") < _ts(STALE_CUT)),
                               updated_at=_ts(STALE_CUT))
    full = rollup.insights_of(facts, updated_at=ntz(EVENTS_AS_OF))
    return dedup.latest_insights(stale.unionByName(full)).select(*INSIGHT_OUT)


# ---- A1-A7 -------------------------------------------------------------------------------

def q_insights_daily(spark, sf_dir):
    return rollup.insights_of(accepted_events(spark, sf_dir)).select(*INSIGHT_OUT)


def q_insights_weekly(spark, sf_dir):
    daily = rollup.insights_of(accepted_events(spark, sf_dir))
    return rollup.regroup_insights(daily, "weekly").select(*INSIGHT_OUT)


def q_insights_monthly(spark, sf_dir):
    daily = rollup.insights_of(accepted_events(spark, sf_dir))
    return rollup.regroup_insights(daily, "monthly").select(*INSIGHT_OUT)


# ---- F1 F2 O1 J1 -------------------------------------------------------------------------

def _daily(spark, sf_dir):
    return rollup.insights_of(accepted_events(spark, sf_dir))


def q_insights_filtered(spark, sf_dir):
    return insights.query_insights(_daily(spark, sf_dir), start=FILTER_START, end=FILTER_END,
                                   platform=FILTER_PLATFORM, region=FILTER_REGION
                                   ).select(*INSIGHT_OUT)


def q_insights_default_range(spark, sf_dir):
    return insights.query_insights(_daily(spark, sf_dir), as_of=INSIGHTS_AS_OF
                                   ).select(*INSIGHT_OUT)


def q_insights_for_owner(spark, sf_dir):
    owners = tables.ad_owners(spark, sf_dir)
    return insights.insights_for_users(_daily(spark, sf_dir), owners,
                                       owners.select("user_id")).select(*INSIGHT_OUT, "user_id")


def q_insights_owner_weekly(spark, sf_dir):
    """J1 -> F1 -> A7 -> O1 in one request batch: every owner asks for the weekly insights of
    each of their campaigns over a date range."""
    owners = tables.ad_owners(spark, sf_dir)
    camps = owners.select(F.col("campaign_id").alias("id"), "user_id")
    return insights.owner_insights(_daily(spark, sf_dir), camps, owners,
                                   start=FILTER_START, end=FILTER_END,
                                   granularity="weekly").select(*INSIGHT_OUT, "user_id")


# ---- A8 A9 -------------------------------------------------------------------------------

def q_reaggregate_range(spark, sf_dir):
    """A stale table (loaded up to a cut inside a day) re-aggregated over whole days."""
    facts = accepted_events(spark, sf_dir)
    current = rollup.insights_of(facts.filter(F.col("event_time") < _ts(STALE_CUT)))
    return rollup.reaggregate(current, facts, REAGG_START, REAGG_END).select(*INSIGHT_OUT)


def increment_batches(facts: DataFrame) -> list[DataFrame]:
    """Arrival batches: by event time, with purchases reported one batch late."""
    c1, c2 = _ts(INCREMENT_CUTS[0]), _ts(INCREMENT_CUTS[1])
    t, late = F.col("event_time"), F.col("event_type") == "purchase"
    return [facts.filter((t < c1) & ~late),
            facts.filter(((t >= c1) & (t < c2) & ~late) | ((t < c1) & late)),
            facts.filter((t >= c2) | ((t >= c1) & (t < c2) & late))]


def q_rollup_incremental(spark, sf_dir):
    """Three arrival batches applied one after the other; equals the full roll-up."""
    checkpoint_dir(spark)
    facts = accepted_events(spark, sf_dir).checkpoint(eager=True)
    current, seen = None, None
    for batch in increment_batches(facts):
        seen = batch if seen is None else seen.unionByName(batch)
        # each increment is stored before the next one arrives
        current = rollup.apply_increment(current, batch, seen).checkpoint(eager=True)
    return current.select(*INSIGHT_OUT)


# ---- F3 F4 U1-U3 J3 ----------------------------------------------------------------------

CAMPAIGN_OUT = ("id", "user_id", "platform", "budget", "start_date", "end_date", "status",
                "created_at")


def _campaign_out(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c == "budget" else F.col(c)
                       for c in CAMPAIGN_OUT + extra])


def q_campaign_list(spark, sf_dir):
    return _campaign_out(campaigns.list_campaigns(tables.ad_campaigns(spark, sf_dir),
                                                  platform="google", status="O"))


def q_campaign_get(spark, sf_dir):
    requests = tables.spend_increments(spark, sf_dir).select(F.col("campaign_id").alias("id"))
    found = campaigns.lookup_campaigns(tables.ad_campaigns(spark, sf_dir), requests)
    return _campaign_out(found, ("found",))


def campaign_changes(spark, sf_dir) -> DataFrame:
    """Change feed from lineitem: new status, budget and flight per campaign, stamped with
    the ship date; the line number breaks ties."""
    li = tables.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("updated_at"),
        F.col("l_linenumber").alias("seq"),
        tables.platform_of(F.col("l_orderkey")).alias("platform"),
        F.col("l_extendedprice").cast(S.BUDGET).alias("budget"),
        F.col("l_shipdate").alias("start_date"),
        (F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("end_date"),
        F.col("l_linestatus").alias("status"))


def q_campaign_upsert(spark, sf_dir):
    target = tables.ad_campaigns(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    updated, _ = campaigns.apply_updates(target, campaign_changes(spark, sf_dir),
                                         changed_at="updated_at", tie="seq")
    return _campaign_out(updated, ("updated_at",))


def _snapshot(spark, sf_dir) -> DataFrame:
    cs = tables.ad_campaigns(spark, sf_dir)
    return cs.filter(F.col("created_at") < _ts(SNAPSHOT_CUT))


def q_campaign_insert_absent(spark, sf_dir):
    """U1 + U3: the full campaign feed inserted into a snapshot taken at a cut date;
    ``outcome`` is ``inserted`` or the conflict reason."""
    _, inserted, conflicts = campaigns.insert_if_absent(
        _snapshot(spark, sf_dir), tables.ad_campaigns(spark, sf_dir))
    return (_campaign_out(inserted).withColumn("outcome", F.lit("inserted"))
            .unionByName(_campaign_out(conflicts, ("reason",))
                         .withColumnRenamed("reason", "outcome")))


def q_campaign_orphans(spark, sf_dir):
    """Spend increments of campaigns missing from the snapshot."""
    return campaigns.orphans(tables.spend_increments(spark, sf_dir), _snapshot(spark, sf_dir)) \
        .select("campaign_id", F.col("spend").cast("double").alias("spend"))


# ---- A10 U4 J2 ---------------------------------------------------------------------------

def q_spend_totals(spark, sf_dir):
    valid, _ = budget.split_increments(tables.spend_increments(spark, sf_dir))
    return budget.spend_totals(valid).select("campaign_id",
                                             F.col("spend").cast("double").alias("spend"))


def q_budget_status(spark, sf_dir):
    valid, _ = budget.split_increments(tables.spend_increments(spark, sf_dir))
    budgets = tables.ad_campaigns(spark, sf_dir).select("id", "budget")
    return budget.budget_status(budgets, budget.spend_totals(valid))


def q_spend_rejects(spark, sf_dir):
    """U4 + J3: invalid amounts and increments for unknown campaigns."""
    rejects = budget.increment_rejects(tables.spend_increments(spark, sf_dir),
                                       tables.ad_campaigns(spark, sf_dir))
    return rejects.select("campaign_id", F.col("spend").cast("double").alias("spend"), "reason")


# ---- C1-C4 -------------------------------------------------------------------------------

def q_audit_unique(spark, sf_dir):
    return quality.duplicate_keys(tables.table(spark, sf_dir, "lineitem"),
                                  ["l_orderkey", "l_linenumber"])


def q_audit_fk(spark, sf_dir):
    t = lambda n: tables.table(spark, sf_dir, n)
    return quality.reference_summary({
        "orders.o_custkey->customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"),
        "lineitem.l_orderkey->orders": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        "events.user_id->customer": (t("events"), "user_id", t("customer"), "c_custkey"),
        "customer.c_nationkey->nation": (t("customer"), "c_nationkey", t("nation"),
                                         "n_nationkey"),
    })


def q_audit_nulls(spark, sf_dir):
    return quality.null_counts(tables.ad_campaigns(spark, sf_dir))


def q_audit_domain(spark, sf_dir):
    """C4 on the campaign source (budget before its decimal cast) and on raw events."""
    orders = tables.table(spark, sf_dir, "orders")
    cs = orders.select(F.col("o_orderkey").alias("id"),
                       tables.platform_of(F.col("o_orderkey")).alias("platform"),
                       F.col("o_totalprice").alias("budget"),
                       F.col("o_orderdate").alias("start_date"),
                       (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("end_date"),
                       F.col("o_orderstatus").alias("status"))
    camp = quality.domain_checks(
        {f"campaigns.{k}": v for k, v in quality.campaign_domain_checks(cs.columns).items()}, cs)
    evs = quality.domain_checks(
        {f"events.{k}": v for k, v in quality.event_domain_checks().items()},
        tables.ad_events_raw(spark, sf_dir))
    return camp.unionByName(evs)


# ---- T5 ----------------------------------------------------------------------------------

def q_fetch_plan(spark, sf_dir):
    return fetch.fetch_plan(tables.ad_campaigns(spark, sf_dir), FETCH_AS_OF)


def q_missing_days(spark, sf_dir):
    facts = accepted_events(spark, sf_dir)
    started = facts.groupBy("campaign_id", "platform").agg(
        F.min("event_time").alias("start_date")).withColumnRenamed("campaign_id", "id")
    plan = fetch.fetch_plan(started, EVENTS_AS_OF)
    return fetch.missing_days(plan, rollup.insights_of(facts))


# ---- S1 S2 P1 P8-P11 J4 ------------------------------------------------------------------

def q_event_json_roundtrip(spark, sf_dir):
    """S2 then P1: every raw event encoded as a keyed JSON message and decoded strictly."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir))
    wire = ev.encode_events(raw)
    decoded = ev.decoded_ok(ev.decode_events(wire, S.event_schema(T.LongType())))
    return _event_out(decoded)


def campaign_external_ids(spark, sf_dir) -> DataFrame:
    """Event campaigns with their platform and external id (``ext-<id>``)."""
    owners = tables.ad_owners(spark, sf_dir)
    return owners.select(F.col("campaign_id").alias("id"),
                         tables.platform_of(F.col("campaign_id")).alias("platform"),
                         F.concat(F.lit("ext-"), F.col("campaign_id").cast("string"))
                         .alias("external_id"))


def q_payload_flatten(spark, sf_dir):
    """P8-P11 + J4: daily stats packed as platform payload pages (JSON text), parsed with the
    payload schema, flattened, and routed back to internal campaign ids."""
    dim = campaign_external_ids(spark, sf_dir)
    daily = _daily(spark, sf_dir).join(
        dim.select(F.col("id").alias("campaign_id"), "external_id"), "campaign_id")
    pages = payloads.pack_payloads(daily)
    wire = pages.select("platform", "external_id",
                        F.to_json(F.struct("data", "paging")).alias("body"))
    parsed = wire.select("platform", "external_id",
                         F.from_json("body", S.PAYLOAD_SCHEMA).alias("p")) \
                 .select("platform", "external_id", "p.*")
    routed, _ = payloads.route_to_campaigns(payloads.flatten_payloads(parsed), dim)
    return routed.select(*[F.col(c).cast("double").alias(c) if c in S.AMOUNTS else F.col(c)
                           for c in EVENT_OUT if c != "id"])


def q_payload_files(spark, sf_dir):
    """S8 + T6 + P8-P11 + J4 from files: daily stats landed as payload pages under
    ``platform=`` folders, read back with the payload schema, routed through the
    platform adapters and the campaign dimension."""
    dim = campaign_external_ids(spark, sf_dir)
    daily = _daily(spark, sf_dir).join(
        dim.select(F.col("id").alias("campaign_id"), "external_id"), "campaign_id")
    root = ingest.scratch_root(spark, "payload-pages")
    payloads.pack_payloads(daily).write.partitionBy("platform").json(root)
    pages = payloads.read_payloads(spark, root, multi_line=False)
    routed, _ = payloads.route_to_campaigns(payloads.adapt_pages(pages), dim)
    return routed.select(*[F.col(c).cast("double").alias(c) if c in S.AMOUNTS else F.col(c)
                           for c in EVENT_OUT if c != "id"])


def q_stream_ingest(spark, sf_dir):
    """The events table as a file stream through ingest (validation, dedup by arrival
    on the per-event replay key against the dedup-state table, fact storage, refresh of the
    touched days); returns the stored insight table."""
    schema = tables.table(spark, sf_dir, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf_dir))
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir, events=stream),
                                          ("platform", "id"))
    root = ingest.scratch_root(spark, "stream-ingest")
    query = ingest.run(raw, root, os.path.join(root, "_checkpoint"),
                       now=F.col("received_at"), processed_at=F.col("processed_at"))
    query.awaitTermination()
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_batch_ingest_store(spark, sf_dir):
    """The batch ingest job over the whole events table: validation, dedup by arrival on the
    per-event replay key, facts stored by day and batch id, insights refreshed for the touched
    days; returns the stored insight table."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), ("platform", "id"))
    root = ingest.scratch_root(spark, "batch-ingest")
    ingest_job.ingest_batch(spark, raw, root, "b1", now=F.col("received_at"),
                            processed_at=F.col("processed_at"))
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_reaggregate_store(spark, sf_dir):
    """A9 as the stored-table job: facts stored, a stale insight table stored, then the range
    re-aggregated from stored facts and its days rewritten; returns the insight table."""
    facts = accepted_events(spark, sf_dir)
    root = ingest.scratch_root(spark, "reaggregate")
    storage.write_facts(facts, root, "all")
    stale = rollup.insights_of(facts.filter(F.col("event_time") < _ts(STALE_CUT)),
                               updated_at=_ts(STALE_CUT))
    storage.write_insights(stale, root)
    reaggregate_job.reaggregate_stored(spark, root, REAGG_START, REAGG_END,
                                       updated_at=ntz(EVENTS_AS_OF))
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


# ---- rows that make the rules bite -------------------------------------------------------

REPLAY_KEY = ("platform", "id")
ARRIVED = dt.datetime(2024, 2, 1)
FAR = 1_000_000_000  # added to an id, it names nothing


def q_dedup_redelivery(spark, sf_dir):
    """D1 over every event delivered twice: the same rows stay as from one delivery."""
    facts = accepted_events(spark, sf_dir, TTL_KEY)
    return _event_out(dedup.first_wins_ttl(facts.unionByName(facts)))


def q_dedup_heavy(spark, sf_dir):
    """D1 with every key on the heavy path."""
    facts = accepted_events(spark, sf_dir, TTL_KEY)
    return _event_out(dedup.first_wins_ttl(facts, light_limit=0))


def q_ingest_two_batches(spark, sf_dir):
    """D1 across batches: all events as one batch, again an hour later (all duplicates), and
    again eight days later (accepted again, but D2 counts each fact once)."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), LAST_WINS_KEY)
    root = ingest.scratch_root(spark, "two-batches")
    for batch, later in (("b1", dt.timedelta()), ("b2", dt.timedelta(hours=1)),
                         ("b3", dt.timedelta(days=8))):
        ingest_job.ingest_batch(spark, raw, root, batch, now=F.col("received_at"),
                                processed_at=F.col("processed_at"), arrived=ARRIVED + later)
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_ingest_late(spark, sf_dir):
    """T4: events arrive in three batches, purchases one batch late, some far behind others of
    their key; none is lost, whatever its own time."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    root = ingest.scratch_root(spark, "late")
    for n, batch in enumerate(reversed(increment_batches(raw))):
        ingest_job.ingest_batch(spark, batch, root, f"b{n}", now=F.col("received_at"),
                                processed_at=F.col("processed_at"),
                                arrived=ARRIVED + dt.timedelta(hours=n))
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_ingest_rerun_corrected(spark, sf_dir):
    """A batch is run again with its clicks a day later; nothing of the first run stays."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    moved = raw.withColumn("event_time", F.when(
        F.col("event_type") == "click", F.col("event_time") + F.expr("INTERVAL 1 DAY"))
        .otherwise(F.col("event_time")))
    root = ingest.scratch_root(spark, "rerun")
    for batch in (raw, moved):
        ingest_job.ingest_batch(spark, batch, root, "b1", now=F.col("received_at"),
                                processed_at=F.col("processed_at"), arrived=ARRIVED)
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_ingest_rerun_loses_keys(spark, sf_dir):
    """T2 + D1: a batch is run again a day later without its clicks, another with no row left;
    a third batch brings all events, and what the re-runs lost is accepted from it."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    kind = F.coalesce("event_type", F.lit(""))
    root = ingest.scratch_root(spark, "rerun-loses")
    day = dt.timedelta(days=1)
    for name, batch, later in (("b1", raw.filter(kind != "purchase"), 0 * day),
                               ("b2", raw.filter(kind == "purchase"), 0 * day),
                               ("b1", raw.filter(~kind.isin("purchase", "click")), day),
                               ("b2", raw.limit(0), day), ("b3", raw, 2 * day)):
        ingest_job.ingest_batch(spark, batch, root, name, now=F.col("received_at"),
                                processed_at=F.col("processed_at"), arrived=ARRIVED + later)
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_ingest_interrupted(spark, sf_dir):
    """T2 + A8 + S3: a stored batch is run again with all events on other days, stopped after
    each step in turn, then with its clicks a day later to the end. Nothing of the stopped runs
    stays, in the facts or in the insights of the days they touched."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    root = ingest.scratch_root(spark, "interrupted")

    def run(shift, steps=len(ingest_job.BatchRun.STEPS)):
        moved = raw.withColumn("event_time", F.col("event_time") + shift)
        ingest_job.ingest_batch(spark, moved, root, "b1", now=F.col("received_at"),
                                processed_at=F.col("processed_at"), arrived=ARRIVED, steps=steps)

    run(F.expr("INTERVAL 0 DAYS"))
    for steps in range(1, len(ingest_job.BatchRun.STEPS)):
        run(F.expr(f"INTERVAL {1000 * steps} DAYS"), steps)
    run(F.when(F.col("event_type") == "click", F.expr("INTERVAL 1 DAY"))
        .otherwise(F.expr("INTERVAL 0 DAYS")))
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_ingest_deltas(spark, sf_dir):
    """A8 as deltas: all events; newer versions of the purchases in another region; older
    versions of the clicks, which lose; the views once more, which change nothing; the days
    compacted; the first batch run again without its signups. The merged deltas are the roll-up
    of the facts that are left."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    kind = F.coalesce("event_type", F.lit(""))
    day = F.expr("INTERVAL 1 DAY")
    root = ingest.scratch_root(spark, "deltas")
    newer = (raw.filter(kind == "purchase").withColumn("region", F.lit("MOVED"))
             .withColumn("processed_at", F.col("processed_at") + day))
    older = (raw.filter(kind == "click").withColumn("region", F.lit("LOST"))
             .withColumn("processed_at", F.col("processed_at") - day))
    for name, batch in (("b1", raw), ("b2", newer), ("b3", older),
                        ("b4", raw.filter(kind == "view")), ("", None),
                        ("b1", raw.filter(kind != "signup")), ("b5", raw.limit(0))):
        if batch is None:
            deltas.compact(spark, root)
        else:
            ingest_job.ingest_batch(spark, batch, root, name, now=F.col("received_at"),
                                    processed_at=F.col("processed_at"), arrived=ARRIVED,
                                    ttl_dedup=False, how=deltas.DeltaRun)
    return deltas.read_delta_insights(spark, root).select(*INSIGHT_OUT)


def land(part: DataFrame, folder: str, files: int) -> None:
    """Add a delivery to a landing folder: exactly ``files`` files, written and read by as many
    tasks, so a stream of ``files`` files a trigger takes one delivery a micro-batch."""
    spark = part.sparkSession
    wanted = len(journal.children(spark, folder)) + files
    part.repartition(files).write.mode("append").parquet(folder)
    # a delivery of few rows leaves tasks without any, which write no file
    for _ in range(wanted - len(journal.children(spark, folder))):
        part.limit(0).coalesce(1).write.mode("append").parquet(folder)


def _landed_stream(spark, sf_dir, root) -> DataFrame:
    """The events as a stream of three deliveries, one a micro-batch, purchases a delivery late."""
    raw = tables.table(spark, sf_dir, "events")
    landed, files = os.path.join(root, "landed"), spark.sparkContext.defaultParallelism
    for part in increment_batches(raw.withColumn("event_time", F.col("ts"))):
        land(part.drop("event_time"), landed, files)
    stream = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files)
              .parquet(landed))
    return tables.with_driver_event_fields(
        tables.ad_events_raw(spark, sf_dir, events=stream), REPLAY_KEY)


def _published(spark, sf_dir, root, attempt: str = "1") -> str:
    """The landed events written to a message log by a stream; returns the log's path."""
    log = os.path.join(root, "log")
    ev.publish(_landed_stream(spark, sf_dir, os.path.join(root, attempt)), fmt=message_log.FORMAT,
               path=log, checkpoint=os.path.join(root, f"_publish-{attempt}"),
               available_now=True).awaitTermination()
    return log


def q_message_log_sink(spark, sf_dir):
    """S2 once only: the events are written to a message log in three epochs, then all epochs
    are replayed from the start; the log holds every message once."""
    root = ingest.scratch_root(spark, "log-sink")
    for attempt in ("1", "2"):
        log = _published(spark, sf_dir, root, attempt)
    messages = spark.read.format(message_log.register(spark)).load(log)
    return _event_out(ev.decoded_ok(ev.decode_events(messages, S.event_schema(T.LongType()))))


def q_message_log_ingest(spark, sf_dir):
    """S1 -> P1 -> store: a consumer starts at the earliest offset of a message log and stops
    half way; segments are delivered again; a second start resumes from its checkpoint and reads
    the rest. Returns the stored insights."""
    root = ingest.scratch_root(spark, "log-ingest")
    log = _published(spark, sf_dir, root)
    size = sum(end for s in message_log.segments(log).values() for _, end, _ in s[-1:])
    for most in (size // 2 + 1, size):
        stream = ev.event_stream(spark, message_log.FORMAT, log,
                                 {"maxOffsetsPerTrigger": str(most)})
        ingest.run(stream, root, os.path.join(root, "_checkpoint"), S.event_schema(T.LongType()),
                   now=F.col("received_at"), processed_at=F.col("processed_at")).awaitTermination()
        message_log.redeliver(log)
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_stream_windows(spark, sf_dir):
    """T3 + T4: daily windows with a watermark of two days over the events in three deliveries,
    purchases a delivery late (most of them behind the watermark), beside the facts query. Open
    days come from the windows, closed ones from the day refresh; no late row is lost."""
    root = ingest.scratch_root(spark, "windows")
    checked = ingest.prepare(_landed_stream(spark, sf_dir, root), now=F.col("received_at"),
                             processed_at=F.col("processed_at"))
    live = windows.start(checked, root, os.path.join(root, "_windows"))
    live.awaitTermination()
    windows.note_watermark(spark, live, root)
    ingest.start(checked, root, os.path.join(root, "_facts"), how=windows.WindowRun
                 ).awaitTermination()
    return windows.read_insights(spark, root).select(*INSIGHT_OUT)


def q_stream_deltas(spark, sf_dir):
    """A8 in a stream: the events land in three deliveries, one micro-batch each, purchases a
    delivery late; every micro-batch adds its deltas and reads no day again."""
    root = ingest.scratch_root(spark, "stream-deltas")
    ingest.run(_landed_stream(spark, sf_dir, root), root, os.path.join(root, "_checkpoint"), now=F.col("received_at"),
               processed_at=F.col("processed_at"), how=deltas.DeltaRun).awaitTermination()
    return deltas.read_delta_insights(spark, root).select(*INSIGHT_OUT)


def _stored(spark, sf_dir, name) -> tuple[str, DataFrame]:
    """A store with all accepted events and their insights."""
    facts = accepted_events(spark, sf_dir)
    root = ingest.scratch_root(spark, name)
    storage.write_facts(facts, root, "all")
    storage.write_insights(rollup.insights_of(facts, ntz(EVENTS_AS_OF)), root)
    return root, facts


def q_reaggregate_corrected_region(spark, sf_dir):
    """Purchases of the range get another region in a newer fact version; the rows of the
    old region go."""
    root, facts = _stored(spark, sf_dir, "region")
    fixed = (rollup.day_range_filter(facts, REAGG_START, REAGG_END)
             .filter(F.col("event_type") == "purchase").withColumn("region", F.lit("MOVED"))
             .withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 1 DAY")))
    storage.write_facts(fixed, root, "fix")
    reaggregate_job.reaggregate_stored(spark, root, REAGG_START, REAGG_END,
                                       updated_at=ntz(EVENTS_AS_OF))
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def _mixed_requests(spark, sf_dir) -> DataFrame:
    """Every owner asks for the own campaign, for one of another user, and for none."""
    owners = tables.ad_owners(spark, sf_dir)
    other = owners.select("campaign_id", (F.col("user_id") + 1).alias("user_id"))
    none = owners.select((F.col("campaign_id") + FAR).alias("campaign_id"), "user_id")
    return owners.unionByName(other).unionByName(none)


def _owned_campaigns(spark, sf_dir) -> DataFrame:
    return tables.ad_owners(spark, sf_dir).select(F.col("campaign_id").alias("id"), "user_id")


def q_insights_request_stored(spark, sf_dir):
    """J1 -> F1/F2 -> A7 -> O1 on the stored table, with foreign and unknown campaigns."""
    root, _ = _stored(spark, sf_dir, "request")
    return request.insights_request(
        spark, root, _mixed_requests(spark, sf_dir), _owned_campaigns(spark, sf_dir),
        as_of=INSIGHTS_AS_OF, start=FILTER_START, granularity="weekly"
    ).select("user_id", "access", "position", *INSIGHT_OUT)


def q_reaggregate_requested(spark, sf_dir):
    """The owner-checked re-aggregation: a stale table, requests of owners and strangers."""
    facts = accepted_events(spark, sf_dir)
    root = ingest.scratch_root(spark, "requested")
    storage.write_facts(facts, root, "all")
    storage.write_insights(rollup.insights_of(
        facts.filter(F.col("event_time") < _ts(STALE_CUT)), ntz(EVENTS_AS_OF)), root)
    reaggregate_job.reaggregate_requested(
        spark, root, _mixed_requests(spark, sf_dir), _owned_campaigns(spark, sf_dir),
        as_of=REAGG_END, start=REAGG_START, updated_at=ntz(EVENTS_AS_OF))
    return storage.read_insights(spark, root).select(*INSIGHT_OUT)


def q_ensure_tables_roundtrip(spark, sf_dir):
    """Tables created with their schema, filled through S3, read through the catalog."""
    root = ingest.scratch_root(spark, "tables")
    database = "adperf_" + os.path.basename(root).replace("-", "_")
    schema = S.event_schema(T.LongType())
    facts_table, _ = storage.ensure_tables(spark, root, schema, database=database)
    empty = spark.table(facts_table)
    assert set(schema.fieldNames()) < set(empty.columns) and empty.isEmpty()
    storage.write_facts(accepted_events(spark, sf_dir), root, "all")
    spark.catalog.recoverPartitions(facts_table)
    return (spark.table(facts_table).groupBy("event_date", "ingest_batch")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("clicks").alias("clicks")))


def q_insights_subcent(spark, sf_dir):
    """Amounts of a thousandth keep their value through validation and sums."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir))
    for m in S.AMOUNTS:
        raw = raw.withColumn(m, (F.col(m).cast(tables.CENTS) * F.expr("0.001BD")).cast(S.MONEY))
    good = validate.accepted(validate.validate(raw, now=F.col("received_at"),
                                               processed_at=F.col("processed_at")))
    return rollup.insights_of(good).select(*INSIGHT_OUT)


def q_validate_reasons(spark, sf_dir):
    """Every reject reason and every default id, counted."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    case = F.col("id") % 11
    broken = raw.select(
        F.when(case == 6, None).otherwise(F.col("id")).alias("id"),
        F.when(case == 0, None).otherwise(F.col("campaign_id")).alias("campaign_id"),
        F.when(case == 1, "").when(case == 5, " ").otherwise(F.col("platform"))
        .alias("platform"),
        F.when(case != 2, F.col("event_time")).alias("event_time"),
        F.when(case != 3, F.col("deduplication_key")).otherwise("").alias("deduplication_key"),
        F.when(case == 4, F.lit(1e30)).otherwise(F.col("spend").cast("double")).alias("spend"),
        case.alias("case"),
        *[c for c in raw.columns if c not in ("id", "campaign_id", "platform", "event_time",
                                              "deduplication_key", "spend")])
    checked = validate.validate(broken, now=_ts(dt.datetime(2024, 1, 1)), keep=("case",))
    return checked.groupBy("reject_reason", "case").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("null_ids"))


def q_spend_rejects_mixed(spark, sf_dir):
    """U4 + J3 with zero, negative, missing amounts and unknown campaigns in the feed."""
    inc = _mixed_spend(spark, sf_dir).drop("updated_at", "seq")
    return budget.increment_rejects(inc, tables.ad_campaigns(spark, sf_dir)).select(
        "campaign_id", F.col("spend").cast("double").alias("spend"), "reason")


def q_campaign_get_unknown(spark, sf_dir):
    """F4 for known and unknown ids."""
    ids = tables.spend_increments(spark, sf_dir).select(F.col("campaign_id").alias("id"))
    requests = ids.unionByName(ids.select((F.col("id") + FAR).alias("id")))
    found = campaigns.lookup_campaigns(tables.ad_campaigns(spark, sf_dir), requests)
    return _campaign_out(found, ("found",))


def q_campaign_list_users(spark, sf_dir):
    """F3 + O2 for every user with a positive account balance, with the position in the list."""
    users = (tables.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
             .select(F.col("c_custkey").alias("user_id")))
    listed = campaigns.list_campaigns(tables.ad_campaigns(spark, sf_dir), users=users,
                                      ordered=False)
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "id")
    return _campaign_out(listed.withColumn("position", F.row_number().over(order)),
                         ("position",))


def q_campaign_insert_dups(spark, sf_dir):
    """U1 + U3: a feed that brings every campaign twice, a day apart, into a snapshot."""
    feed = tables.ad_campaigns(spark, sf_dir)
    again = feed.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    _, inserted, conflicts = campaigns.insert_if_absent(_snapshot(spark, sf_dir),
                                                        again.unionByName(feed))
    return (_campaign_out(inserted).withColumn("outcome", F.lit("inserted"))
            .unionByName(_campaign_out(conflicts, ("reason",))
                         .withColumnRenamed("reason", "outcome")))


def q_audit_fk_orphans(spark, sf_dir):
    """C2 against parents without their overdrawn customers and old orders."""
    t = lambda n: tables.table(spark, sf_dir, n)
    customers = t("customer").filter(F.col("c_acctbal") >= 0)
    return quality.reference_summary({
        "orders.o_custkey->customer": (t("orders"), "o_custkey", customers, "c_custkey"),
        "events.user_id->customer": (t("events"), "user_id", customers, "c_custkey"),
        "lineitem.l_orderkey->orders": (
            t("lineitem"), "l_orderkey",
            t("orders").filter(F.col("o_orderdate") >= _ts(SNAPSHOT_CUT)), "o_orderkey"),
    })


def _broken_campaigns(spark, sf_dir) -> DataFrame:
    """Campaigns with nulls, overflowing budgets, unknown platforms, long texts and flights
    that end before they start, by their order's status and priority."""
    o = tables.table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.nullif(F.col("o_custkey") % 10, F.lit(3)).alias("user_id"),
        F.when(status == "F", F.lit("other")).when(status == "P", F.repeat(F.lit("x"), F.lit(51)))
        .otherwise(tables.platform_of(F.col("o_orderkey"))).alias("platform"),
        F.when(status == "O", F.col("o_totalprice") * 1e8).otherwise(F.col("o_totalprice"))
        .alias("budget"),
        F.nullif(F.col("o_orderdate"), F.col("o_orderdate")).alias("start_none"),
        F.col("o_orderdate").alias("start_date"),
        (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("end_date"),
        F.when(status == "P", F.repeat(status, F.lit(60))).otherwise(status).alias("status"),
        F.when(status != "F", F.repeat(status, F.lit(256))).alias("name"),
        F.repeat(F.lit("e"), (F.col("o_orderkey") % 300).cast("int")).alias("external_id"))


def q_audit_nulls_found(spark, sf_dir):
    return quality.null_counts(_broken_campaigns(spark, sf_dir),
                               ["id", "user_id", "start_none", "name", "platform"])


def q_audit_domain_found(spark, sf_dir):
    """C4 with violations of every campaign and user rule."""
    broken = _broken_campaigns(spark, sf_dir)
    camp = quality.domain_checks(quality.campaign_domain_checks(broken.columns), broken)
    c = tables.table(spark, sf_dir, "customer")
    length = (F.col("c_custkey") % 300).cast("int")
    users = c.select(F.repeat(F.lit("m"), length).alias("email"),
                     F.repeat(F.lit("n"), length + 1).alias("name"),
                     F.repeat(F.lit("r"), length + 2).alias("role"))
    found = quality.domain_checks(quality.user_domain_checks(), users)
    return (camp.select(F.concat(F.lit("campaigns."), "check_name").alias("check_name"),
                        "violations")
            .unionByName(found.select(F.concat(F.lit("users."), "check_name")
                                      .alias("check_name"), "violations")))


def q_audit_currency(spark, sf_dir):
    """Campaigns whose facts mix currencies: purchases are booked in another one."""
    facts = accepted_events(spark, sf_dir).withColumn("currency", F.when(
        F.col("event_type") == "purchase", F.lit("EUR")).otherwise(F.col("currency")))
    return quality.mixed_currency(facts)


def q_event_json_any_case(spark, sf_dir):
    """Keys in upper case decode as well."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir))
    wire = raw.select(F.to_json(F.struct(*[F.col(c).alias(c.upper()) for c in raw.columns]),
                                ev.WRITE_OPTIONS).alias("value"))
    return _event_out(ev.decoded_ok(ev.decode_events(wire, S.event_schema(T.LongType()))))


def q_fetch_publish(spark, sf_dir):
    """The fetch -> publish job: pages landed, read, routed, published and decoded again."""
    dim = campaign_external_ids(spark, sf_dir)
    daily = _daily(spark, sf_dir).join(
        dim.select(F.col("id").alias("campaign_id"), "external_id"), "campaign_id")
    root = ingest.scratch_root(spark, "publish")
    landed, out = os.path.join(root, "landed"), os.path.join(root, "out")
    payloads.pack_payloads(daily).write.partitionBy("platform").json(landed)
    publish.publish_landed(spark, landed, dim, fmt="parquet", path=out)
    decoded = ev.decoded_ok(ev.decode_events(
        spark.read.schema("key string, value string").parquet(out), S.event_schema(T.LongType())))
    return decoded.select(*[F.col(c).cast("double").alias(c) if c in S.AMOUNTS else F.col(c)
                            for c in EVENT_OUT if c != "id"])


def _mixed_spend(spark, sf_dir) -> DataFrame:
    """Spend updates with their time and number: zero, negative and missing amounts, unknown
    and missing campaigns among them."""
    line = F.col("l_linenumber")
    return tables.table(spark, sf_dir, "lineitem").select(
        F.when(line == 6, F.col("l_orderkey") + FAR).when(line != 7, F.col("l_orderkey"))
        .alias("campaign_id"),
        F.when(line == 4, 0).when(line != 3, F.col("l_extendedprice").cast(S.BUDGET) - 20000)
        .cast(S.BUDGET).alias("spend"),
        F.col("l_shipdate").alias("updated_at"), line.alias("seq"))


def q_spend_running(spark, sf_dir):
    """A10 + J2 per update: the total after every accepted update, in the order of time and
    number, and the update at which a campaign becomes overspent."""
    updates = budget.running_spend(
        _mixed_spend(spark, sf_dir),
        tables.ad_campaigns(spark, sf_dir).selectExpr(
            "id", "budget * 0.25BD AS budget", "budget * 0.01BD AS spend"), ["updated_at", "seq"])
    return updates.select("campaign_id", "updated_at", "seq", *[
        F.col(c).cast("double").alias(c) for c in ("spend", "new_spend", "remaining")],
        "status", "became_overspent")


def _judged_changes(spark, sf_dir) -> DataFrame:
    """The change feed with its sender: every second change comes from another user, every
    sixth line names an unknown campaign."""
    owner = tables.ad_campaigns(spark, sf_dir).select("id", "user_id")
    changes = campaign_changes(spark, sf_dir).join(owner, "id")
    return changes.withColumns({
        "user_id": F.when(F.col("seq") % 2 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")),
        "id": F.when(F.col("seq") == 6, F.col("id") + FAR).otherwise(F.col("id"))})


def q_campaign_update_owned(spark, sf_dir):
    """U2 + J1: the campaign table after the changes of its owners alone."""
    target = tables.ad_campaigns(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    updated, _ = campaigns.apply_owned_updates(target, _judged_changes(spark, sf_dir), tie="seq")
    return _campaign_out(updated, ("updated_at",))


def q_campaign_update_refused(spark, sf_dir):
    """U2 + J1 + J3: the changes that are refused, and why."""
    target = tables.ad_campaigns(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    _, refused = campaigns.apply_owned_updates(target, _judged_changes(spark, sf_dir), tie="seq")
    return refused.select("id", "user_id", "updated_at", "seq", "access")


def q_fetch_plan_owned(spark, sf_dir):
    """T5 + J1: fetch requests for own, foreign and unknown campaigns."""
    camps = tables.ad_campaigns(spark, sf_dir)
    own = camps.select(F.col("id").alias("campaign_id"), "user_id")
    asked = (own.unionByName(own.withColumn("user_id", F.col("user_id") + 1))
             .unionByName(own.withColumn("campaign_id", F.col("campaign_id") + FAR)))
    return fetch.owned_fetch_plan(asked, camps, FETCH_AS_OF)


def q_store_retention(spark, sf_dir):
    """Retention: days before the range's start go from a store, the others stay as they are."""
    root, _ = _stored(spark, sf_dir, "retention")
    retention.expire(spark, root, FILTER_START)
    again = rollup.insights_of(storage.read_facts(spark, root))
    kept = storage.read_insights(spark, root).select(*INSIGHT_OUT)
    # what the facts still give is what the insight table still holds
    return kept.intersectAll(again.select(*INSIGHT_OUT))


def q_insights_clustered(spark, sf_dir):
    """O3 + F1 on S6: insights clustered by campaign and day, late events that rewrite days after
    that, and the campaigns of one user over a range read from both."""
    facts = accepted_events(spark, sf_dir)
    root = ingest.scratch_root(spark, "clustered")
    late = (F.col("event_time") >= _ts(STALE_CUT)) & (F.col("event_type") == "purchase")
    storage.write_facts(facts.filter(~late), root, "first")
    refresh.refresh_days(spark, root, storage.fact_days(spark, root), ntz(EVENTS_AS_OF))
    cluster.cluster_insights(spark, root, rows_per_file=2_000)
    days = storage.write_facts(facts.filter(late), root, "late")
    refresh.refresh_days(spark, root, days, ntz(EVENTS_AS_OF))
    owned = _owned_campaigns(spark, sf_dir).where(F.col("user_id") == CLUSTER_USER)
    asked = owned.select(F.col("id").alias("campaign_id"))  # grows with the store: joined
    return cluster.read_clustered(spark, root, asked, FILTER_START, FILTER_END).select(
        *INSIGHT_OUT)


def q_dimension_scans(spark, sf_dir):
    """S7 + F7: campaigns and users landed with more columns than the schemas name, a password
    among them, and read back."""
    root = ingest.scratch_root(spark, "dimensions")
    people = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat("c_name", F.lit("@example.org")).alias("email"),
        F.sha2("c_name", 256).alias("password"), F.col("c_acctbal").alias("unnamed"))
    people.write.parquet(os.path.join(root, "users"))
    tables.ad_campaigns(spark, sf_dir).withColumn("unnamed", F.lit(1)).write.parquet(
        os.path.join(root, "campaigns"))
    users = dimensions.read_users(spark, os.path.join(root, "users"))
    camps = dimensions.read_campaigns(spark, os.path.join(root, "campaigns"))
    secret = sum(c in dimensions.SENSITIVE_COLUMNS for c in users.columns)
    return camps.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").select(
        "id", "user_id", "email", "platform", F.col("budget").cast("double").alias("budget"),
        "status", "name", F.lit(secret).alias("secret_columns"))


def q_validate_stamps(spark, sf_dir):
    """P5 + P6: received and processed stamps of every event; a third of them came without."""
    raw = tables.with_driver_event_fields(tables.ad_events_raw(spark, sf_dir), REPLAY_KEY)
    raw = raw.withColumn("received_at", F.when(F.col("id") % 3 > 0, F.col("received_at")))
    checked = validate.validate(raw, now=_ts(ARRIVED), processed_at=_ts(ARRIVED) + F.expr(
        "INTERVAL 5 SECONDS"))
    return validate.accepted(checked).select("id", "received_at", "processed_at")


def q_parse_days(spark, sf_dir):
    """P12 on a column: strict ``YYYY-MM-DD``; other spellings of the ship date are refused."""
    day, line = F.col("l_shipdate"), F.col("l_linenumber")
    text = (F.when(line == 2, F.date_format(day, "yyyy/MM/dd"))
            .when(line == 3, F.date_format(day, "dd-MM-yyyy"))
            .when(line == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("x")))
            .when(line == 5, F.concat(F.date_format(day, "yyyy"), F.lit("-13-01")))
            .when(line == 6, F.lit("")).when(line == 7, F.lit(None))
            .otherwise(F.date_format(day, "yyyy-MM-dd")))
    li = tables.table(spark, sf_dir, "lineitem").select(line.alias("line"), text.alias("text"))
    return (li.withColumn("day", try_day(F.col("text"))).groupBy("line", "day")
            .agg(F.count(F.lit(1)).alias("n")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "validate_accept": q_validate_accept,
    "validate_rejects": q_validate_rejects,
    "dedup_first_ttl": q_dedup_first_ttl,
    "dedup_last": q_dedup_last,
    "insights_latest": q_insights_latest,
    "insights_daily": q_insights_daily,
    "insights_weekly": q_insights_weekly,
    "insights_monthly": q_insights_monthly,
    "insights_filtered": q_insights_filtered,
    "insights_default_range": q_insights_default_range,
    "insights_for_owner": q_insights_for_owner,
    "insights_owner_weekly": q_insights_owner_weekly,
    "reaggregate_range": q_reaggregate_range,
    "rollup_incremental": q_rollup_incremental,
    "campaign_list": q_campaign_list,
    "campaign_get": q_campaign_get,
    "campaign_upsert": q_campaign_upsert,
    "campaign_insert_absent": q_campaign_insert_absent,
    "campaign_orphans": q_campaign_orphans,
    "budget_status": q_budget_status,
    "spend_totals": q_spend_totals,
    "spend_rejects": q_spend_rejects,
    "audit_unique": q_audit_unique,
    "audit_fk": q_audit_fk,
    "audit_nulls": q_audit_nulls,
    "audit_domain": q_audit_domain,
    "fetch_plan": q_fetch_plan,
    "missing_days": q_missing_days,
    "event_json_roundtrip": q_event_json_roundtrip,
    "payload_flatten": q_payload_flatten,
    "payload_files": q_payload_files,
    "stream_ingest": q_stream_ingest,
    "batch_ingest_store": q_batch_ingest_store,
    "reaggregate_store": q_reaggregate_store,
    "dedup_redelivery": q_dedup_redelivery,
    "dedup_heavy": q_dedup_heavy,
    "ingest_two_batches": q_ingest_two_batches,
    "ingest_late": q_ingest_late,
    "ingest_rerun_corrected": q_ingest_rerun_corrected,
    "ingest_rerun_loses_keys": q_ingest_rerun_loses_keys,
    "reaggregate_corrected_region": q_reaggregate_corrected_region,
    "reaggregate_requested": q_reaggregate_requested,
    "insights_request_stored": q_insights_request_stored,
    "ensure_tables_roundtrip": q_ensure_tables_roundtrip,
    "insights_subcent": q_insights_subcent,
    "validate_reasons": q_validate_reasons,
    "spend_rejects_mixed": q_spend_rejects_mixed,
    "campaign_get_unknown": q_campaign_get_unknown,
    "campaign_list_users": q_campaign_list_users,
    "campaign_insert_dups": q_campaign_insert_dups,
    "audit_fk_orphans": q_audit_fk_orphans,
    "audit_nulls_found": q_audit_nulls_found,
    "audit_domain_found": q_audit_domain_found,
    "audit_currency": q_audit_currency,
    "event_json_any_case": q_event_json_any_case,
    "fetch_publish": q_fetch_publish,
    "insights_clustered": q_insights_clustered,
    "ingest_interrupted": q_ingest_interrupted,
    "ingest_deltas": q_ingest_deltas,
    "stream_deltas": q_stream_deltas,
    "stream_windows": q_stream_windows,
    "message_log_sink": q_message_log_sink,
    "message_log_ingest": q_message_log_ingest,
    "store_retention": q_store_retention,
    "dimension_scans": q_dimension_scans,
    "validate_stamps": q_validate_stamps,
    "parse_days": q_parse_days,
    "spend_running": q_spend_running,
    "campaign_update_owned": q_campaign_update_owned,
    "campaign_update_refused": q_campaign_update_refused,
    "fetch_plan_owned": q_fetch_plan_owned,
}

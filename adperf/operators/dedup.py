"""Deduplication: first-wins with a TTL (D1), last-wins by version.

Last-wins is an aggregate (``max`` of a struct led by the version columns), not a window: the
partial aggregate runs before the shuffle, so a key holding a third of all rows is reduced on
the map side instead of landing whole in one task.

First-wins with a TTL restarts the clock only on accepted rows, so it is a greedy chain per
key: accept the first row, then the first row at least ``ttl`` later, and so on. It is solved
without ordering a whole key in one task:

1. rows at the same ``(key, clock)`` can never both be accepted (0 < ttl): keep the smallest id;
2. ``succ(n)`` = first node of the same key with ``clock >= n.clock + ttl`` - a forward as-of
   join (:func:`next_at_or_after`) partitioned by ``(key, time bucket)``;
3. the accepted nodes are those reachable from each key's first node through ``succ``: pointer
   doubling, ``log2(longest chain)`` rounds of equi-joins. The longest chain is bounded by the
   key's time span divided by the TTL.

Keys with few candidates (the usual case) skip 2-3: their candidates, at most
``light_limit`` per key, are sorted into one array and folded with ``aggregate`` in a single
pass. Both paths are exact; only the heavy path is used for keys above the limit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adperf import schemas as S
from adperf.session import checkpoint_dir


# ---- last-wins ----------------------------------------------------------------------------

def last_wins(df: DataFrame, keys: tuple[str, ...] | list[str],
              order: tuple[str, ...] | list[str] = ("processed_at", "id")) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` tuple (ties: later columns).

    Column order of ``df`` is kept.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest])
    winners = df.groupBy(*keys).agg(F.max(packed).alias("_w"))
    return winners.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in order + rest]) \
                  .select(*df.columns)


def latest_facts(facts: DataFrame, keys=S.FACT_KEY) -> DataFrame:
    """Stored facts, last ``processed_at`` per fact key."""
    return last_wins(facts, keys, ("processed_at", "id"))


def latest_insights(insights: DataFrame, keys=S.INSIGHT_KEY) -> DataFrame:
    """D3: insight versions, last ``updated_at`` per insight key."""
    return last_wins(insights, keys, ("updated_at",))


# ---- forward as-of join -------------------------------------------------------------------

def _hour_bucket(t: Column, bucket_hours: int) -> Column:
    """Time bucket index that needs no time zone (works on TIMESTAMP_NTZ)."""
    hours = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 24 \
        + F.hour(t).cast("long")
    return F.floor(hours / F.lit(bucket_hours)).cast("long")


def next_at_or_after(probes: DataFrame, targets: DataFrame, key: str, probe_t: str,
                     target_t: str, out: str = "next_t", bucket_hours: int = 24) -> DataFrame:
    """For each probe row, the smallest ``targets.target_t >= probe_t`` with the same ``key``.

    Returns the ``probes`` columns plus ``out`` (null when none). Two passes, both
    running-frame windows (linear, spillable): inside the probe's time bucket, then over the
    per-bucket minima of the key, which has one row per non-empty bucket however many rows
    the key holds. Probe rows travel through the window as one struct, so nothing is joined
    back by a generated id.
    """
    t_type = targets.schema[target_t].dataType
    row = F.struct(*[F.col(c) for c in probes.columns])
    pb = probes.select(F.col(key), F.col(probe_t).alias("_t"), F.lit(1).alias("_kind"),
                       F.lit(None).cast(t_type).alias("_v"), row.alias("_row"))
    row_type = pb.schema["_row"].dataType
    tg = targets.select(F.col(key), F.col(target_t).alias("_t"), F.lit(0).alias("_kind"),
                        F.col(target_t).alias("_v"), F.lit(None).cast(row_type).alias("_row"))
    both = pb.unionByName(tg).withColumn("_b", _hour_bucket(F.col("_t"), bucket_hours))
    # pass 1: inside the bucket. Time descending; at equal time targets (kind 0) come first,
    # so a target equal to the probe counts.
    w_in = (Window.partitionBy(key, "_b").orderBy(F.col("_t").desc(), F.col("_kind").asc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (both.withColumn("_in", F.min("_v").over(w_in))
              .filter(F.col("_kind") == 1)
              .select(key, "_b", "_row", "_in"))
    # pass 2: first non-empty later bucket. Probe-bucket markers sort before the bucket
    # minimum of the same bucket index, so only strictly later buckets count.
    minima = (tg.withColumn("_b", _hour_bucket(F.col("_t"), bucket_hours))
              .groupBy(key, "_b").agg(F.min("_t").alias("_v")).withColumn("_kind", F.lit(0)))
    markers = (inside.filter(F.col("_in").isNull()).select(key, "_b").distinct()
               .withColumn("_v", F.lit(None).cast(t_type)).withColumn("_kind", F.lit(1)))
    w_out = (Window.partitionBy(key).orderBy(F.col("_b").desc(), F.col("_kind").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = (minima.unionByName(markers)
             .withColumn("_later", F.min("_v").over(w_out))
             .filter(F.col("_kind") == 1)
             .select(key, "_b", "_later"))
    return (inside.join(later, [key, "_b"], "left")
            .select("_row.*", F.coalesce("_in", "_later").alias(out)))


# ---- first-wins with TTL ------------------------------------------------------------------

def _materialize(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


LIGHT_LIMIT = 10_000


def _fold_light(nodes: DataFrame, key: str, clock: str, ttl_days: int) -> DataFrame:
    """Exact TTL fold of keys with few candidates: one sorted array per key (bounded by the
    caller), folded with the built-in ``aggregate`` starting from the key's seed (``_seed``,
    its last accepted time before this input, or null); returns accepted
    ``(key, clock, _id)``."""
    item = F.struct(F.col(clock).alias("t"), F.col("_id").alias("i"))
    ttl = F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    elem_type = nodes.select(item.alias("x")).schema["x"].dataType

    def step(acc, x):
        take = acc["last"].isNull() | (x["t"] >= acc["last"] + ttl)
        return F.when(take, F.struct(x["t"].alias("last"),
                                     F.array_append(acc["acc"], x).alias("acc"))).otherwise(acc)

    grouped = nodes.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"),
                                     F.max("_seed").alias("_seed"))
    init = F.struct(F.col("_seed").alias("last"),
                    F.array().cast(T.ArrayType(elem_type)).alias("acc"))
    folded = grouped.select(key, F.aggregate("_items", init, step)["acc"].alias("_acc"))
    return (folded.select(key, F.explode("_acc").alias("_a"))
            .select(key, F.col("_a.t").alias(clock), F.col("_a.i").alias("_id")))


def _chain_heavy(nodes: DataFrame, key: str, clock: str, ttl_days: int,
                 bucket_hours: int) -> DataFrame:
    """Exact TTL chain for keys of any size: as-of successor + pointer doubling."""
    ttl = F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    probes = nodes.select(key, F.col(clock).alias("_t"), (F.col(clock) + ttl).alias("_p"))
    succ = next_at_or_after(probes, nodes, key, "_p", clock, out="_n",
                            bucket_hours=bucket_hours).select(key, "_t", "_n")
    succ = _materialize(succ)
    # longest possible chain: span / ttl + 1 (one scalar to the driver)
    span_days = (nodes.groupBy(key)
                 .agg(F.datediff(F.max(F.to_date(clock)), F.min(F.to_date(clock))).alias("d"))
                 .agg(F.max("d")).first()[0]) or 0
    longest = span_days // ttl_days + 2
    rounds = max(1, math.ceil(math.log2(longest)))  # 2**rounds >= longest
    reach = nodes.groupBy(key).agg(F.min(clock).alias("_t"))
    jump = succ  # (key, _t) -> _n = succ^(2^k)
    for k in range(rounds):
        step = (reach.join(jump, [key, "_t"])
                .filter(F.col("_n").isNotNull())
                .select(key, F.col("_n").alias("_t")))
        reach = _materialize(reach.unionByName(step).distinct())
        if k < rounds - 1:
            j2 = jump.select(F.col(key).alias("_k2"), F.col("_t").alias("_m"),
                             F.col("_n").alias("_n2"))
            jump = _materialize(
                jump.join(j2, (F.col(key) == F.col("_k2")) & (F.col("_n") == F.col("_m")),
                          "left")
                .select(key, "_t", F.col("_n2").alias("_n")))
    return (reach.join(nodes.withColumnRenamed(clock, "_t"), [key, "_t"])
            .filter(~F.col("_is_seed"))  # seed nodes were accepted by an earlier run
            .select(key, F.col("_t").alias(clock), "_id"))


def first_wins_ttl(df: DataFrame, key: str = "deduplication_key", clock: str = "received_at",
                   ttl_days: int = S.DEDUP_TTL_DAYS, tie: str = "id",
                   bucket_hours: int = 1, light_limit: int = LIGHT_LIMIT,
                   seeds: DataFrame | None = None) -> DataFrame:
    """Rows accepted by a first-wins dedup whose key expires ``ttl_days`` after the last
    *accepted* row (skipped duplicates do not extend it). Rows with a null key pass through.

    Exact for any data. Keys with at most ``light_limit`` distinct clock values are folded in
    one aggregate; heavier keys (a key may hold a third of all rows) take the as-of + pointer
    doubling path, ``ceil(log2(longest chain))`` rounds of equi-joins, with no group held in one
    task. ``light_limit=0`` sends every key down the doubling path.

    ``seeds`` (``key``, ``last_accepted``) continues an earlier run: a key's chain starts at its
    last accepted time, so rows before it or within ``ttl`` of it are duplicates. This is how a
    backfill applies the same exact rule part by part. Live ingest judges by arrival instead:
    see :func:`first_wins_arrival`.
    """
    keyed = df.filter(F.col(key).isNotNull())
    unkeyed = df.filter(F.col(key).isNull())

    # one candidate per (key, clock): rows at the same instant cannot both be accepted. The
    # whole row travels with its candidate, so a redelivered copy of it is never picked up again
    rest = [c for c in df.columns if c not in (key, clock, tie)]
    candidates = _materialize(keyed.groupBy(key, clock).agg(
        F.min(F.struct(tie, *rest)).alias("_row")))
    nodes = candidates.select(key, clock, F.col(f"_row.{tie}").alias("_id"))
    t_type = nodes.schema[clock].dataType
    if seeds is not None:
        last = _materialize(seeds.groupBy(key).agg(
            F.max("last_accepted").cast(t_type).alias("_seed")))
        # rows at or before the seed can never be accepted again
        nodes = (nodes.join(last, key, "left")
                 .filter(F.col("_seed").isNull() | (F.col(clock) > F.col("_seed"))))
    else:
        nodes = nodes.withColumn("_seed", F.lit(None).cast(t_type))
    nodes = _materialize(nodes)
    # keys above the limit: at most (candidates / limit) of them, usually none. The split
    # never shuffles the candidates by key alone (a hot key would land in one task): with no
    # heavy key there is no join, otherwise the bounded key list is broadcast when small.
    heavy_keys = (nodes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > light_limit).select(key))
    has_heavy = light_limit <= 0 or heavy_keys.limit(1).count() > 0
    if has_heavy and light_limit > 0:
        heavy_keys = _materialize(heavy_keys)
    parts = []
    if light_limit > 0:
        light = nodes.join(heavy_keys, key, "left_anti") if has_heavy else nodes
        parts.append(_fold_light(light, key, clock, ttl_days))
    if has_heavy:
        heavy = nodes if light_limit <= 0 else nodes.join(heavy_keys, key, "left_semi")
        seed_nodes = (heavy.filter(F.col("_seed").isNotNull())
                      .select(key, F.col("_seed").alias(clock)).distinct()
                      .withColumn("_id", F.lit(None).cast(heavy.schema["_id"].dataType))
                      .withColumn("_is_seed", F.lit(True)))
        heavy = (heavy.select(key, clock, "_id").withColumn("_is_seed", F.lit(False))
                 .unionByName(seed_nodes))
        parts.append(_chain_heavy(heavy, key, clock, ttl_days, bucket_hours))
    winners = union_all(parts).select(key, clock)
    kept = (candidates.join(winners, [key, clock], "left_semi")
            .select(key, clock, f"_row.{tie}", *[F.col(f"_row.{c}").alias(c) for c in rest])
            .select(*df.columns))
    return kept.unionByName(unkeyed)


def first_wins_arrival(df: DataFrame, arrived: Column, state: DataFrame | None = None,
                       key: str = "deduplication_key",
                       order: tuple[str, ...] = ("received_at", "id"),
                       ttl_days: int = S.DEDUP_TTL_DAYS,
                       state_partitions: int | None = None) -> DataFrame:
    """D1 for live ingest: the rows of one batch that a dedup judging by arrival accepts.

    All rows of a batch share one arrival stamp, so at most one row per key is accepted (the
    first by ``order``; an aggregate with map-side combine), and none whose key was accepted
    less than ``ttl_days`` before the batch arrived. ``state`` is ``(key, accepted_at)`` of
    earlier batches. Event time plays no part, so late rows are judged like any other; rows
    with a null key pass through.

    ``state_partitions``: the state lies in as many buckets by ``key``. The batch's first rows
    are dealt to them, and the state is joined where it lies.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    first = (df.filter(F.col(key).isNotNull()).groupBy(key)
             .agg(F.min(F.struct(*order, *rest)).alias("_row"))
             .select(key, "_row.*").select(*df.columns))
    if state is not None:
        live = state.filter(F.col("accepted_at")
                            > arrived - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
        if state_partitions:
            first = first.repartition(state_partitions, key)
        first = first.join(live.select(key), key, "left_anti")
    return first.unionByName(df.filter(F.col(key).isNull()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

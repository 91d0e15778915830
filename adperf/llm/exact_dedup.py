"""Exact dedup through a minimal perfect hash over the distinct digests.

The distinct digests are dealt by their leading bits into buckets of about ``BUCKET_KEYS``
keys. Each bucket gets its own minimal perfect hash (levels of collision-free bits, ranked by
popcount), and a slot table: the slot holds the full digest, the locator of the winner and the
group's size. A row is looked up in its bucket: hash to a slot, then compare all digest bytes.
A member gets the winner's locator; a nonmember (no slot, or other bytes in it) is new and is
grouped by its digest apart from the index.

Skew: groups of copies are pre-aggregated per map task when the index is built; lookups of a
bucket are salted by the row's place into parts of about ``PART_ROWS`` rows, each with its own copy
of that bucket's (bounded) slots, so a text that holds a third of all rows meets no single task.

Edge cases: a null text counts as empty; texts of any length are hashed whole; an empty table
gives no rows; repeated rows (the same id twice) count separately and are all kept when their id
wins; null ids sort before all others; columns of the input other than id and text are not
read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

BUCKET_KEYS = 2048
PART_ROWS = 4096
GAMMA = 2  # bits of a level per key still without a slot
INDEX_SCHEMA = "bucket long, levels binary, digests binary, winners array<long>, sizes array<long>"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and SHA-256 of the UTF-8 text (null: empty), as hex and as bytes."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    return d.withColumn("digest", F.unhex("text_sha256"))


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    """Position source of each 32-byte digest in a level: one of its words, re-mixed."""
    words = keys.view(np.uint64).reshape(-1, 4)
    h = words[:, 1 + level % 3] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the perfect hash: a key owns the first level bit that no other key hits."""
    levels, left = [], keys
    while len(left):
        size = max(8, GAMMA * len(left))
        at = (_level_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
        own = np.bincount(at, minlength=size) == 1
        levels.append(own)
        left = left[~own[at]]
    return levels


def slots_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 when no level holds it."""
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for n, own in enumerate(levels):
        at = (_level_hash(keys[open_], n) % np.uint64(len(own))).astype(np.int64)
        hit = own[at]
        rank = np.cumsum(own) - 1
        out[open_[hit]] = base + rank[at[hit]]
        open_, base = open_[~hit], base + int(own.sum())
    return out


def _pack(levels: list[np.ndarray]) -> bytes:
    head = np.array([len(levels), *map(len, levels)], np.int64).tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in levels)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    sizes, at, out = np.frombuffer(blob[8:8 + 8 * n], np.int64), 8 + 8 * n, []
    for size in sizes:
        step = (int(size) + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob[at:at + step], np.uint8))[:size].astype(bool))
        at += step
    return out


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _one_list(values: pa.ChunkedArray) -> pa.Array:
    values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _index_bucket(rows: pa.Table) -> pa.Table:
    keys = _keys(rows["digest"])
    levels = build_levels(keys)
    order = np.argsort(slots_of(levels, keys))
    rows = rows.take(pa.array(order))
    return pa.table({"bucket": rows["bucket"].slice(0, 1),
                     "levels": pa.array([_pack(levels)], pa.binary()),
                     "digests": pa.array([keys[order].tobytes()], pa.binary()),
                     "winners": _one_list(rows["winner"]), "sizes": _one_list(rows["n"])})


def bucket_of(buckets: int):
    lead = F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long")
    return F.pmod(lead, F.lit(buckets))


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """Index over the digests of ``rows`` (from :func:`digests`): one row per bucket."""
    groups = cut(rows.groupBy("digest", "text_sha256")
                 .agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")), "op8-groups")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    index = (groups.select("digest", "winner", "n", bucket_of(buckets).alias("bucket"))
             .groupBy("bucket")
             .applyInArrow(_index_bucket, INDEX_SCHEMA))
    return cut(index, "op8-index"), buckets


def _look_up(rows: pa.Table, index: pa.Table) -> pa.Table:
    out = rows.select(["doc_id", "text_sha256", "recent"])
    ids, sizes = pa.nulls(len(rows), pa.int64()), pa.array(np.zeros(len(rows), np.int64))
    if len(index) and len(rows):
        entry = {c: index[c][0] for c in ("levels", "digests", "winners", "sizes")}
        keys = _keys(rows["digest"])
        slot = slots_of(_unpack(entry["levels"].as_py()), keys)
        stored = np.frombuffer(entry["digests"].as_py(), np.uint8).reshape(-1, 32)
        member = (slot >= 0) & (stored[np.maximum(slot, 0)] == keys).all(axis=1)
        at = pa.array(slot, mask=~member)
        ids = entry["winners"].values.take(at)
        sizes = pc.fill_null(entry["sizes"].values.take(at), 0)
    return out.append_column("winner", ids).append_column("size", sizes)


def look_up(rows: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Winner and group size in the history of each row; null and 0 for digests it lacks."""
    rows = rows.withColumn("bucket", bucket_of(buckets))
    parts = (rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
             .select("bucket", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    # the row's own number deals rows that repeat an id over all parts
    rows = (rows.withColumn("uid", F.monotonically_increasing_id()).join(parts, "bucket")
            .withColumn("part", F.pmod(F.xxhash64("doc_id", "uid"), F.col("parts")))
            .select("doc_id", "text_sha256", "recent", "digest", "bucket", "part"))
    index = (index.join(parts, "bucket")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("part", F.col("part").cast("long")).drop("parts"))
    return rows.groupBy("bucket", "part").cogroup(index.groupBy("bucket", "part")).applyInArrow(
        _look_up, "doc_id long, text_sha256 string, recent boolean, winner long, size long")


def dedup(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """keep_id, group_size and kept for each row of ``rows`` (from :func:`digests`).

    ``history`` holds digests seen before: rows whose digest it has are repeats of its winner.
    The others are grouped among themselves, the largest id winning. Without a history the
    older half of the table is its own (see :func:`older_half`): all rows are looked up in the
    index over it, and the recent rows are counted by digest, members beside nonmembers; the
    largest id of a group wins, be it in the slot or among the recent rows.
    """
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id"))
           .alias("kept"), "text_sha256"]
    own = history is None
    rows = older_half(rows) if own else rows.withColumn("recent", F.lit(True))
    index, buckets = build_index(rows.where(~F.col("recent")) if own else history)
    found = cut(look_up(rows, index, buckets), "op8-found")
    met = found.where(F.col("recent") & (F.lit(own) | (F.col("size") == 0)))
    # a written table, so AQE can split the join at a hot text
    groups = cut(met.groupBy("text_sha256").agg(F.max("doc_id").alias("w"),
                                                F.count(F.lit(1)).alias("g")), "op8-recent")
    found = found.join(groups, "text_sha256", "left").withColumns({
        "keep_id": F.greatest("winner", "w"),
        "group_size": F.col("size") + F.coalesce("g", F.lit(0))})
    if own:
        return found.select(*out)
    old = F.col("size") > 0
    return found.withColumn("keep_id", F.when(old, F.col("winner")).otherwise(F.col("w"))).select(
        *out[:3], (~old & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256")


def older_half(rows: DataFrame) -> DataFrame:
    """``rows`` with ``recent``: whether the id lies above the middle of the ids' range. Rows
    without an id are of the older half, as are all when there is one id only."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(None if low is None else low + (high - low) // 2).cast("long")
    return rows.withColumn("recent", F.coalesce(F.col("doc_id") > middle, F.lit(False)))

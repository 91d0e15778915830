"""Best-fit packing of documents into sequences, with conflicts.

A bin holds at most ``CAPACITY`` tokens (words), no two documents of one source and no two of
one duplicate cluster (equal texts up to case and spacing). Documents are cut into pieces of
the capacity (a full piece fills a bin alone) and a rest. Pieces are dealt by a hash
into groups of about ``GROUP`` pieces, each packed by itself: largest first, the bins in order
of their residual, and the search for a piece starts at the tightest residual
that holds it and goes on to the successor until a bin is compatible. Bins carry their sources
and clusters as bitmaps, so a test is two ANDs.

Skew: the group of a piece depends on its id, its number and the place of its row, so a source,
a cluster or one id that holds a third of all rows is dealt over all groups; a group has about
``GROUP`` pieces, within chance.

Edge cases: a null, empty or wordless text has no token and no piece (it is reported with no
bin); a null source is a source of its own; a text longer than the capacity takes several bins;
rows that repeat an id are packed one by one, as equal texts into different bins; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP = 4096


def best_fit(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece of one group; ``sources`` and ``clusters`` are small ints."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    free: list[tuple[int, int]] = []  # (residual, bin), the successor list
    held: list[list[int]] = []  # source and cluster bitmap of each bin
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        source, cluster = 1 << sources[i], 1 << clusters[i]
        at = bisect_left(free, (sizes[i], -1))
        while at < len(free):
            marks = held[free[at][1]]
            if not (marks[0] & source or marks[1] & cluster):
                break
            at += 1
        if at < len(free):
            residual, b = free.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= source
        held[b][1] |= cluster
        bins[i], offsets[i] = b, capacity - residual
        insort(free, (residual - sizes[i], b))
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, source, cluster, piece number and size of every piece of every document."""
    words = F.regexp_count(F.col("text"), F.lit("[^\\x09-\\x0D ]+"))
    normal = F.trim(F.regexp_replace(F.lower("text"), "[\\x09-\\x0D ]+", " "))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),
        F.sha2(F.coalesce(normal, F.lit("")), 256).alias("cluster"),
        F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens"))
    count = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    cut = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    rows = rows.select("*", F.explode_outer(cut).alias("piece"))
    left = F.col("n_tokens") - F.col("piece") * F.lit(capacity)
    size = F.when(left > capacity, capacity).otherwise(F.coalesce(left, F.lit(0)))
    return rows.withColumn("size", size.cast("int"))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Bin and offset of every piece: doc_id, piece, size, source, bin, bin_offset."""
    # a full piece has capacity words of two bytes or more with their spaces, so this bounds
    # the number of pieces
    n = docs.agg(F.count(F.lit(1)).alias("rows"),
                 F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(n["rows"] + n["bytes"] // (2 * capacity)) // group))
    # the row's own number deals rows that repeat an id over all groups
    dealt = pieces(docs, capacity).withColumn("part", F.pmod(
        F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def pack_group(part: pa.Table) -> pa.Table:
        part = part.sort_by([("size", "descending"), ("doc_id", "ascending"),
                             ("piece", "ascending"), ("cluster", "ascending")])
        some = part.slice(0, pc.sum(pc.greater(part["size"], 0)).as_py() or 0)
        sources, clusters = (
            some[c].combine_chunks().dictionary_encode().indices.to_pylist()
            for c in ("source", "cluster"))
        bins, offsets = best_fit(some["size"].to_pylist(), sources, clusters, capacity)
        name, empty = part["part"][0].as_py(), [None] * (len(part) - len(some))
        return pa.table({
            "doc_id": part["doc_id"], "piece": part["piece"], "size": part["size"],
            "source": part["source"], "bin": [f"g{name}-{b}" for b in bins] + empty,
            "bin_offset": pa.array(offsets + empty, pa.int32())})

    out = (dealt.select("doc_id", "piece", "size", "source", "cluster", "part").groupBy("part")
           .applyInArrow(pack_group, "doc_id long, piece int, size int, source string, "
                                     "bin string, bin_offset int"))
    source = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30))
    return out.withColumn("source", source)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Bins, tokens and the share of the capacity that is used."""
    return packed.where(F.col("bin").isNotNull()).agg(
        F.countDistinct("bin").alias("bins"), F.sum("size").alias("tokens"),
        (F.sum("size") / (F.countDistinct("bin") * F.lit(capacity))).alias("fill"))

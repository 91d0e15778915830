"""Repeated byte strings across documents by a distributed enhanced suffix array.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller id. The suffix array is built only where it can hold a repeat, in buckets:

1. Every window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string with the smallest
   hash. Equal windows have equal anchors, so a window whose anchor stands in one text only is
   unique. One shuffle by the anchor's hash tells which anchors at least two texts share (within
   a batch, equal texts and texts that share an anchor are already settled before the shuffle,
   so an anchor of a third of all documents sends one row a batch, not one a document).
2. The windows around shared anchors become records: the bytes under all consecutive windows of
   one anchor. Records overlap, so their bytes are several times the text's: only their places
   and 128-bit names are kept. Equal records are one, with their smallest document (a map-side
   aggregate); an anchor with one record only (inside a passage) is settled by that.
3. One record of each name of the other anchors is cut out of its text, and these are dealt by
   anchor to buckets. A bucket sorts the suffixes
   that start at its window starts, computes the common prefixes of neighbours, and scans them with a stack: every
   interval of common prefix ``LENGTH`` or more whose occurrences differ in the byte to their
   left (or start a record) is a maximal repeat group. An interval with one left byte is the
   tail of the interval one byte earlier, which covers it. In each group all occurrences in
   documents after its smallest one are removed.
4. The records of an anchor with more than ``HOT`` different ones (a common phrase) are anchored
   again by longer strings (``FINE``), which part them into shorter records; those alone with
   their anchor are unique, the others are dealt to buckets too. Where more than ``HOT`` share
   even the longest (a passage that very many documents go on from differently), they are split by the
   first ``LENGTH`` bytes of their suffixes, which no interval crosses: each is an aggregate with
   map-side combine.
5. Occurrences get the result of their record; the ranges of a document are merged and cut out.

Steps 2 to 5 take the shared anchors in slices, as many as keep the text under the anchors of one
at ``1 / SLICES`` of all text, so disk stays in proportion where most anchors are shared.

Texts that equal one with a smaller id are settled by their digest alone.

Edge cases: null and empty texts have 0 bytes; texts shorter than ``LENGTH`` are never cut; an
id names one text (rows that repeat it are one document and do not remove each other's bytes);
rows with a null id are returned whole; matches never cross documents; texts of any length are
taken whole; ids are compared, so there are no ties; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .tables import cut, discard

LENGTH = 50
GRAM = 20
FINE = (35, 45)  # bytes of the anchors of records that a hot anchor has too many of
HOT = 2000
SLICES = 3  # of a corpus in which every anchor is shared
BUCKET_RECORDS = 4000
SETTLE_BYTES = 4 << 20  # text whose anchors are settled at once, before the shuffle
U64 = np.uint64
RANGES = "array<struct<lo: int, hi: int>>"


def anchors(data: np.ndarray, off: np.ndarray, size_of: int = GRAM):
    """Windows of a chunk by anchor: document, first and last start, and the anchor's hash.

    One entry for each run of consecutive window starts of a document with one anchor.
    """
    n, w = len(data), LENGTH - size_of + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(U64)
    up, down = B.powers(n + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(B.BYTE_CODES[data] * up[:n])])
    gram = B.mix((sums[size_of:] - sums[:-size_of]) * down[:n - size_of + 1])
    # sliding minimum of (upper hash half, place): the leftmost of the smallest
    low = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    windows = n - LENGTH + 1
    low = np.minimum(low[:windows], low[w - size:w - size + windows])
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    start = np.flatnonzero(np.arange(windows) + LENGTH <= off[doc + 1])
    if not len(start):
        return none, none, none, none.view(U64)
    doc, at = doc[start], at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    return doc[head], start[head], start[tail], gram[at[head]]


def _low(h: np.ndarray) -> np.ndarray:
    return (h & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(route, doc_id, tag, kind) rows of the anchors of each batch.

    kind 0: an anchor that the batch saw in one text; route is its hash, tag marks the text.
    kind 1: a marker that the batch saw the anchor ``route`` in several texts. kind 2: a document
    of such an anchor, already settled; route only spreads the rows, tag is the anchor.
    """

    def settle_batch(h: np.ndarray, ids: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, tag, h))
        h, ids, tag = h[order], ids[order], tag[order]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_text = new_h.copy()
        new_text[1:] |= tag[1:] != tag[:-1]
        # equal texts: only the smallest id can be the one that stays
        h, ids, tag, new_h = h[new_text], ids[new_text], tag[new_text], new_h[new_text]
        size = np.diff(np.append(np.flatnonzero(new_h), len(h)))
        many = np.repeat(size > 1, size)
        mark = h[new_h][size > 1]
        route = np.concatenate([h[~many], mark, B.mix(ids[many].astype(U64) ^ h[many])])
        none = np.zeros(len(mark), np.int64)
        kind = np.repeat(np.array([0, 1, 2], np.int8),
                         [len(h) - int(many.sum()), len(mark), int(many.sum())])
        return pa.RecordBatch.from_arrays(
            [pa.array(B.as_long(route)), pa.array(np.concatenate([ids[~many], none, ids[many]])),
             pa.array(np.concatenate([tag[~many], none, _low(h[many]).astype(np.int64)])),
             pa.array(kind)], names=["route", "doc_id", "tag", "kind"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(2).to_numpy(zero_copy_only=False)
            parts, n_bytes = [], 0
            for a, b, data, off in B.chunks(batch.column(1)):
                doc, _, _, h = anchors(data, off)
                parts.append((h, ids[a:b][doc], tags[a:b][doc]))
                n_bytes += len(data)
                if n_bytes >= SETTLE_BYTES or b == batch.num_rows:
                    yield settle_batch(*map(np.concatenate, zip(*parts)))
                    parts, n_bytes = [], 0

    return docs.mapInArrow(scan, "route long, doc_id long, tag long, kind byte")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor) of anchors in several texts, from rows sorted by route.

    Of an anchor seen in one text so far only the smallest document is carried to the next
    batch, and a mark once it is settled.
    """
    held = None  # (route, doc_id, tag, settled) of the last anchor
    for batch in batches:
        route, ids, tag, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        done = kind == 2
        out_ids, out_anchor = [ids[done]], [tag[done].astype(np.int32)]
        route, ids, tag, kind = route[~done], ids[~done], tag[~done], kind[~done]
        if len(route):
            if held is not None:
                route, ids, tag = (np.append(np.array([v], x.dtype), x) for v, x in
                                   zip(held[:3], (route, ids, tag)))
                kind = np.append(np.array([1 if held[3] else 0], kind.dtype), kind)
            new = np.ones(len(route), bool)
            new[1:] = route[1:] != route[:-1]
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(route)))
            plain = kind == 0
            lo = np.minimum.reduceat(np.where(plain, tag, 1 << 62), head)
            hi = np.maximum.reduceat(np.where(plain, tag, -(1 << 62)), head)
            settled = np.logical_or.reduceat(kind == 1, head) | (lo < hi)
            take = np.repeat(settled, size) & plain
            out_ids.append(ids[take])
            out_anchor.append(_low(route[take].view(U64)))
            last = head[-1]
            if plain[last:].any():
                last += int(np.argmin(np.where(plain[last:], ids[last:], np.iinfo(np.int64).max)))
            held = (route[last], ids[last], tag[last], bool(settled[-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_anchor))],
            names=["doc_id", "anchor"])


def shared_anchors(docs: DataFrame) -> DataFrame:
    """doc_id and the anchors (lower hash halves) that another text has too."""
    tag = F.shiftrightunsigned(F.xxhash64("text"), 16)  # 48 bits
    rows = _anchor_rows(docs.select("doc_id", "text", tag.alias("tag")))
    settled = (rows.repartition("route").sortWithinPartitions("route")
               .mapInArrow(_settle, "doc_id long, anchor int"))
    return settled.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


def _cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[x:y] for x, y in zip(start.tolist(), end.tolist())], pa.binary())


def _names() -> list:
    return [F.xxhash64("bytes").alias("r1"), F.xxhash64(F.lit(LENGTH), "bytes").alias("r2")]


def _records(texts: DataFrame) -> DataFrame:
    """Records of (doc_id, text, anchors) rows: where the bytes under the windows of each shared
    anchor start, how many they are and the two hashes that name them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(2)
            for a, b, data, off in B.chunks(batch.column(1)):
                doc, lo, hi, h = anchors(data, off)
                if not len(doc):
                    continue
                keys = [np.asarray(x.values) for x in shared.slice(a, b - a)]
                first = np.searchsorted(doc, np.arange(b - a + 1))
                low = _low(h)
                ok = np.concatenate([np.isin(low[first[i]:first[i + 1]], keys[i])
                                     for i in range(b - a)])
                doc, lo, hi, h = doc[ok], lo[ok], hi[ok], h[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(B.as_long(h)), batch.column(0).slice(a, b - a).take(pa.array(doc)),
                     pa.array((lo - off[doc]).astype(np.int32)),
                     _cut_out(data, lo, hi + LENGTH)], names=["h", "doc_id", "lo", "bytes"])

    found = texts.mapInArrow(scan, "h long, doc_id long, lo int, bytes binary")
    return found.select("h", "doc_id", "lo", F.octet_length("bytes").alias("size"), *_names())


def _record_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, r1, r2, doc_id, bytes and ``hot`` of records (h, r1, r2, doc_id, lo, size, hot)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.chunks(batch.column(1)):
                mine = batch.column(2).slice(a, b - a)
                n = pc.list_value_length(mine).to_numpy(zero_copy_only=False)
                h, r1, r2, lo, size, hot = mine.flatten().flatten()
                doc = np.repeat(np.arange(b - a), n)
                start = off[doc] + lo.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [h, r1, r2, batch.column(0).slice(a, b - a).take(pa.array(doc)),
                     _cut_out(data, start, start + size.to_numpy()), hot],
                    names=["h", "r1", "r2", "doc_id", "bytes", "hot"])

    lists = wanted.groupBy("doc_id").agg(
        F.collect_list(F.struct("h", "r1", "r2", "lo", "size", "hot")).alias("wanted"))
    found = docs.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        scan, "h long, r1 long, r2 long, doc_id long, bytes binary, hot boolean")
    # an id of several texts: the place is in one of them
    r1, r2 = _names()
    return found.where((F.col("r1") == r1) & (F.col("r2") == r2))


def sorted_suffixes(records: list[bytes]):
    """Suffix array over the window starts of ``records`` and the common prefixes of
    neighbours (no longer than either suffix): record, start, available length, lcp."""
    size = np.array([len(r) for r in records])
    starts = size - LENGTH + 1
    rec = np.repeat(np.arange(len(records)), starts)
    at = np.arange(len(rec)) - np.repeat(np.cumsum(starts) - starts, starts)
    words = -(-int(size.max()) // 8)
    buffer = np.frombuffer(b"".join(records) + bytes(8 * words + 8), np.uint8)
    place = np.repeat(np.cumsum(size) - size, starts) + at
    length = size[rec] - at
    rows = np.lib.stride_tricks.sliding_window_view(buffer, 8 * words)[place]
    rows[np.arange(8 * words)[None, :] >= length[:, None]] = 0
    keys = rows.view(">u8").astype(U64)
    order = np.lexsort((length, *keys.T[::-1]))
    rec, at, length, rows = rec[order], at[order], length[order], rows[order]
    lcp = np.zeros(len(rec), np.int64)
    if len(rec) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 * words)
        lcp[1:] = np.minimum(first, np.minimum(length[1:], length[:-1]))
    return rec, at, length, lcp


def maximal_intervals(lcp, left, inner, least):
    """Stack scan of the common-prefix interval tree.

    Intervals of depth ``LENGTH`` or more whose occurrences have several left bytes, or one that
    starts its record (``inner`` false): (first, end, depth, smallest document). ``left`` and
    ``least`` hold each suffix's left byte and document.
    """
    out, stack = [], []  # stack of [depth, first, smallest document, left byte or -2]
    n = len(lcp)
    depth_of, left_of = lcp.tolist(), np.where(inner, left, -2).tolist()
    least_of = least.tolist()
    for i in range(1, n + 1):
        depth = depth_of[i] if i < n else 0
        first, doc, byte = i - 1, least_of[i - 1], left_of[i - 1]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            # what was scanned since the interval opened belongs to it
            doc, first = min(doc, top[2]), top[1]
            byte = byte if byte == top[3] else -2
            if byte == -2:
                out.append((first, i, top[0], doc))
        if depth >= LENGTH:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                top[2] = min(top[2], doc)
                top[3] = top[3] if top[3] == byte else -2
            else:
                stack.append([depth, first, doc, byte])
    return out


def _left_bytes(records: list[bytes], rec: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.array([len(r) for r in records])
    buffer = np.frombuffer(b"".join(records), np.uint8)
    return buffer[np.maximum((np.cumsum(size) - size)[rec] + at - 1, 0)].astype(np.int64)


def _bucket(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Byte ranges, inside each record, that repeat a smaller document than its own."""
    records = [bytes(x) for x in part["bytes"]]
    doc = part["doc_id"].to_numpy()
    rec, at, _, lcp = sorted_suffixes(records)
    intervals = maximal_intervals(lcp, _left_bytes(records, rec, at), at > 0, doc[rec])
    reach = np.zeros(len(rec), np.int64)
    if intervals:
        first, end, depth, least = (np.array(x) for x in zip(*intervals))
        n = end - first
        member = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        later = doc[rec[member]] > np.repeat(least, n)
        np.maximum.at(reach, member[later], np.repeat(depth, n)[later])
    hit = np.flatnonzero(reach)
    hit = hit[np.lexsort((at[hit], rec[hit]))]
    out: dict[int, list] = {}
    for r, a, m in zip(rec[hit].tolist(), at[hit].tolist(), reach[hit].tolist()):
        ranges = out.setdefault(r, [])
        if ranges and a <= ranges[-1]["hi"]:
            ranges[-1]["hi"] = max(ranges[-1]["hi"], a + m)
        else:
            ranges.append({"lo": a, "hi": a + m})
    rows = list(out)
    shift = part["at"].tolist()
    found = [[{"lo": x["lo"] + shift[r], "hi": x["hi"] + shift[r]} for x in ranges]
             for r, ranges in out.items()]
    return pd.DataFrame({**{c: part[c].to_numpy()[rows] for c in ("r1", "r2")},
                         "ranges": pd.Series(found, dtype=object)})


def _bucket_ranges(rows: DataFrame, n: int) -> DataFrame:
    """r1, r2 and ranges from ``n`` rows (anchor, r1, r2, doc_id, at, bytes), ``at`` being
    where in its record a row's bytes start."""
    bucket = F.pmod("anchor", F.lit(max(1, -(-n // BUCKET_RECORDS)))).alias("bucket")
    return (rows.select(bucket, "r1", "r2", "doc_id", "at", "bytes").groupBy("bucket")
            .applyInPandas(_bucket, f"r1 long, r2 long, ranges {RANGES}"))


def _refined(rows: DataFrame, size: int) -> DataFrame:
    """(anchor, r1, r2, doc_id, at, bytes) rows, parted by anchors of ``size`` bytes. Equal
    windows have equal ones, so they meet again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.chunks(batch.column(4)):
                rec, lo, hi, h = anchors(data, off, size)
                r1, r2, doc, at = (batch.column(i).take(pa.array(rec + a)) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(B.as_long(h)), r1, r2, doc,
                     pa.array((at.to_numpy() + lo - off[rec]).astype(np.int32)),
                     _cut_out(data, lo, hi + LENGTH)],
                    names=["anchor", "r1", "r2", "doc_id", "at", "bytes"])

    return rows.select("r1", "r2", "doc_id", "at", "bytes").mapInArrow(
        scan, "anchor long, r1 long, r2 long, doc_id long, at int, bytes binary")


def _prefixes(rows: DataFrame) -> DataFrame:
    """r1, r2, doc_id, and the first ``LENGTH`` bytes of each suffix of rows of :func:`_refined`
    with its place ``at`` in the record."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.subtract(pc.binary_length(batch.column(4)), LENGTH - 1).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            whole = batch.column(4).to_pylist()
            found = [whole[r][a:a + LENGTH] for r, a in zip(row.tolist(), at.tolist())]
            at = at + batch.column(3).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(row)) for i in range(3)),
                 pa.array(at.astype(np.int32)), pa.array(found, pa.binary())],
                names=["r1", "r2", "doc_id", "at", "prefix"])

    return rows.select("r1", "r2", "doc_id", "at", "bytes").mapInArrow(
        starts, "r1 long, r2 long, doc_id long, at int, prefix binary")


def _prefix_ranges(found: DataFrame) -> DataFrame:
    """r1, r2 and ranges of rows of :func:`_prefixes`."""
    least = found.groupBy("prefix").agg(F.min("doc_id").alias("least"))
    later = found.join(least, "prefix").where(F.col("doc_id") > F.col("least"))
    one = F.struct(F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    return later.groupBy("r1", "r2").agg(F.collect_set(one).alias("ranges"))


def _hot_ranges(hot: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """r1, r2 and ranges of the records (r1, r2, doc_id, bytes) of hot anchors, and the written
    tables that they are read from."""
    rows, found, made = hot.withColumn("at", F.lit(0)), [], []
    for size in FINE:
        parts = cut(_refined(rows, size), "op6-parts")
        # what is alone with its anchor is unique
        shared = cut(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                     "op6-fine")
        made += [parts, shared]
        cool, shared = shared.where(F.col("n") <= HOT), shared.where(F.col("n") > HOT)
        n = cool.agg(F.sum("n")).first()[0] or 0
        found.append(_bucket_ranges(parts.join(cool, "anchor"), n))
        if not shared.head(1):
            break
        rows = parts.join(shared, "anchor")
    else:
        made.append(cut(_prefixes(rows), "op6-prefixes"))
        found.append(_prefix_ranges(made[-1]))
    ranges = (reduce(DataFrame.unionByName, found).groupBy("r1", "r2")
              .agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    return ranges, made


def _slice_ranges(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id and ranges by the anchors of (doc_id, text, anchors) rows."""
    records = cut(_records(texts), "op6-records", heavy=True)
    # equal bytes have equal anchors: r1 and r2 alone name a record
    one = cut(records.groupBy("h", "r1", "r2").agg(
        F.min("doc_id").alias("least"), F.min_by("lo", "doc_id").alias("lo"),
        F.min("size").alias("size"), F.count(F.lit(1)).alias("n")), "op6-distinct", heavy=True)
    # an anchor whose records are all equal is settled: its later documents repeat the first
    per = one.groupBy("h").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") > 1)
    several = cut(one.join(per, "h").select(
        "h", "r1", "r2", F.col("least").alias("doc_id"), "lo", "size",
        (F.col("records") > HOT).alias("hot")), "op6-several", heavy=True)
    repeated = cut(one.where(F.col("n") > 1).select("r1", "r2", "least"), "op6-repeated")
    discard(one)
    n = several.count()
    found = cut(_record_bytes(docs, several), "op6-bytes", heavy=True)
    discard(several)
    cool = found.where(~F.col("hot")).withColumns({"anchor": F.col("h"), "at": F.lit(0)})
    intervals, made = _bucket_ranges(cool, n), [found]
    if found.where("hot").head(1):
        more, tables = _hot_ranges(found.where("hot"))
        intervals, made = intervals.unionByName(more), [found, *tables]
    intervals = cut(intervals, "op6-intervals", heavy=True)
    discard(*made)
    result = repeated.join(intervals, ["r1", "r2"], "full")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("size").alias("hi")))
    hits = (records.drop("h").join(result, ["r1", "r2"])
            .select("doc_id", "lo", F.when(F.col("doc_id") > F.col("least"), whole)
                    .otherwise(F.col("ranges")).alias("ranges")))
    moved = F.transform("ranges", lambda r: F.struct(
        (r["lo"] + F.col("lo")).alias("lo"), (r["hi"] + F.col("lo")).alias("hi")))
    out = cut(hits.where(F.col("ranges").isNotNull()).select("doc_id", moved.alias("ranges"))
              .groupBy("doc_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges")),
              "op6-ranges", heavy=True)
    discard(records, repeated, intervals)
    return out


def repeated_ranges(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id and byte ranges (overlapping, unsorted) that repeat a smaller document, for rows
    (doc_id, text); texts equal to one with a smaller id (``firsts``) are left out."""
    shared = cut(shared_anchors(docs), "op6-shared", heavy=True)
    own = firsts.where("doc_id = first_id")
    under = shared.agg(F.sum(F.size("anchors"))).first()[0] or 0
    under *= (LENGTH - GRAM + 2) // 2  # bytes from one anchor to the next
    slices = max(1, -(-SLICES * under // (own.agg(F.sum("size")).first()[0] or 1)))
    texts = docs.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    out = []
    for k in range(slices):
        some = shared
        if slices > 1:
            some = shared.select("doc_id", F.filter("anchors", lambda a: F.pmod(
                F.hash(a), F.lit(slices)) == k).alias("anchors")).where(F.size("anchors") > 0)
        out.append(_slice_ranges(docs, texts.join(some, "doc_id").select(
            "doc_id", "text", "anchors")))
    discard(shared)
    if slices == 1:
        return out[0]
    merged = cut(reduce(DataFrame.unionByName, out).groupBy("doc_id").agg(
        F.flatten(F.collect_list("ranges")).alias("ranges")), "op6-merged", heavy=True)
    discard(*out)
    return merged


def first_ids(docs: DataFrame) -> DataFrame:
    """doc_id, the smallest id with an equal text and the text's number of bytes."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "sha").select("doc_id", "first_id", "size")


def _cut_text(raw: bytes, ranges) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed, and of maximal removed runs."""
    parts, left, removed, runs, end = [], 0, 0, 0, -1
    for lo, hi in ranges:
        if lo > end:
            runs += 1
        if hi > end:
            lo = max(lo, end)
            parts.append(raw[left:lo])
            removed += hi - lo
            left = end = hi
    return b"".join([*parts, raw[left:]]), removed, runs


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    firsts = cut(first_ids(docs), "op6-first")
    ranges = repeated_ranges(docs.where(F.col("doc_id").isNotNull()), firsts)
    copies = firsts.where("doc_id > first_id").groupBy("doc_id").agg(
        F.min("first_id").alias("first_id"))
    rows = (docs.join(copies.join(ranges, "doc_id", "full"), "doc_id", "left")
            .select("doc_id", "text", "ranges", "first_id"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, least_ids = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for i, (doc, least) in enumerate(zip(ids, least_ids)):
                raw = batch.column(1)[i].as_buffer().to_pybytes()
                if least is not None and len(raw) >= LENGTH:
                    left, removed, runs = b"", len(raw), 1
                else:
                    spans = batch.column(2)[i].as_py() or []
                    left, removed, runs = _cut_text(
                        raw, sorted((r["lo"], r["hi"]) for r in spans))
                out.append((doc, len(raw), removed, runs, hashlib.sha256(left).hexdigest()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            types = [pa.int64()] * 4 + [pa.string()]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  "kept_sha256 string")

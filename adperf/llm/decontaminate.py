"""Benchmark decontamination with a broadcast set of test n-grams.

The benchmark's distinct windows (ten consecutive normalised words; a shorter item is one
window) go to every task as sorted hashes with the window texts. A task hashes every window of
every document, looks the hash up, and verifies a hit by comparing the words themselves.

The broadcast is bounded: ``BLOCK_WINDOWS`` windows at most. A larger benchmark is dealt by
window hash into blocks of that size, each broadcast to a scan of its own that adds its hits to
those of the scans before, so no window is left out.

Edge cases: null or wordless texts have no words and are never hit; an item without words has
no window; items with equal texts are all reported; a text shorter than a window can only hold
short items' windows; repeated document rows are scanned and returned one by one; null item ids
are reported as the string ``null``; texts of any length are scanned whole, chunk by chunk; an
empty benchmark hits nothing and an empty table gives no rows; other columns of either table are not read (the pipeline
stage carries them along untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .tables import bounded_batches, free_name

WINDOW = 10
BLOCK_WINDOWS = 200_000
FILTER_BITS = 22

WINDOW_SCHEMA = "h long, n_words int, words binary, item_id string"


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> bytes:
    """Normalised words a..b of a chunk, joined by one space."""
    low = B.LOWER[data[start[a]:end[b - 1]]].tobytes()
    base = int(start[a])
    return b" ".join(low[int(s) - base:int(e) - base] for s, e in zip(start[a:b], end[a:b]))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window and item: hash, word count, words, item id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, _, data, off in B.chunks(batch.column(1)):
                start, end, h, first = B.words(data, off, B.ALNUM_WORDS)
                for i in range(len(off) - 1):
                    lo, hi = int(first[i]), int(first[i + 1])
                    n = min(window, hi - lo)
                    if n:
                        for at, v in enumerate(B.as_long(B.runs_hash(h[lo:hi], n)).tolist(), lo):
                            rows.append((v, n, _joined(data, start, end, at, at + n), ids[a + i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*rows) if rows else [[]] * 4,
                    [pa.int64(), pa.int32(), pa.binary(), pa.string()])],
                names=["h", "n_words", "words", "item_id"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
                             .alias("item_id"), "text")
    return items.mapInArrow(scan, WINDOW_SCHEMA)


def _lookup(rows: list) -> dict:
    """Broadcast value: per window length sorted hashes and a bit filter; items by words."""
    items: dict[bytes, set[str]] = {}
    hashes: dict[int, set[int]] = {}
    for r in rows:
        items.setdefault(bytes(r.words), set()).add(r.item_id)
        hashes.setdefault(r.n_words, set()).add(r.h)
    by_length = {}
    for n, hs in hashes.items():
        h = np.array(sorted(hs), np.int64)
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[h & ((1 << FILTER_BITS) - 1)] = True
        by_length[n] = (h, np.packbits(bits))
    return {"items": {w: sorted(i) for w, i in items.items()}, "by_length": by_length}


def _scan_chunk(data: np.ndarray, off: np.ndarray, known: dict):
    """Words, verified hit ranges (word positions) and items of each document of a chunk."""
    start, end, h, first = B.words(data, off, B.ALNUM_WORDS)
    n_docs = len(off) - 1
    hits: list[list] = [[] for _ in range(n_docs)]
    items: list[set] = [set() for _ in range(n_docs)]
    doc_of = np.repeat(np.arange(n_docs), np.diff(first))
    for n, (sorted_h, bits) in known["filters"].items():
        w = B.as_long(B.runs_hash(h, n))
        at = np.flatnonzero(bits[w & ((1 << FILTER_BITS) - 1)])
        at = at[doc_of[at] == doc_of[at + n - 1]]
        if len(at):
            pos = np.minimum(np.searchsorted(sorted_h, w[at]), len(sorted_h) - 1)
            at = at[sorted_h[pos] == w[at]]
        for i in at.tolist():
            found = known["items"].get(_joined(data, start, end, i, i + n))
            if found:  # the words agree, not only the hash
                d = int(doc_of[i])
                hits[d].append((i - int(first[d]), i - int(first[d]) + n))
                items[d].update(found)
    return np.diff(first), hits, items, (start, end, first)


def _merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(r) for r in out]


def _scanner(shared, text_at: int):
    """mapInArrow function: adds a block's findings to the last three columns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        known = {"items": value["items"],
                 "filters": {n: (h, np.unpackbits(b).astype(bool))
                             for n, (h, b) in value["by_length"].items()}}
        for batch in batches:
            words = np.zeros(batch.num_rows, np.int64)
            *rest, _, hits, items = batch.columns
            types = [x.type for x in batch.columns[-2:]]
            hits, items = hits.to_pylist(), items.to_pylist()
            for a, b, data, off in B.chunks(batch.column(text_at)):
                words[a:b], new_hits, new_items, _ = _scan_chunk(data, off, known)
                for i in range(b - a):
                    if new_hits[i]:
                        old = [(x["lo"], x["hi"]) for x in hits[a + i]]
                        hits[a + i] = [{"lo": x, "hi": y} for x, y in _merged(old + new_hits[i])]
                        items[a + i] = sorted({*items[a + i], *new_items[i]})
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(words), pa.array(hits, types[0]), pa.array(items, types[1])],
                names=batch.schema.names)

    return scan


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list]:
    """The benchmark's windows in blocks of at most about ``BLOCK_WINDOWS`` rows.

    All rows of one window text share a hash and so a block.
    """
    windows = item_windows(benchmark, window).distinct()
    n = windows.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod("h", F.lit(blocks)) == b)
        yield part.collect()  # at most BLOCK_WINDOWS rows on average: the size is counted


def _with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int,
               names: list[str], then=None, schema=None) -> DataFrame:
    """``docs`` and three more columns: word count, hit word ranges, items.

    ``then`` (batches to batches of ``schema``) runs in the same task as the last scan.
    """
    empty = ["CAST(0 AS BIGINT)", "CAST(array() AS array<struct<lo: int, hi: int>>)",
             "CAST(array() AS array<string>)"]
    out = bounded_batches(docs).select("*", *[F.expr(e).alias(n) for e, n in zip(empty, names)])
    scan = None
    for block in _blocks(benchmark, window):
        if scan is not None:
            out = out.mapInArrow(scan, out.schema)
        shared = docs.sparkSession.sparkContext.broadcast(_lookup(block))
        scan = _scanner(shared, docs.columns.index(text_col))
    if then is None:
        return out.mapInArrow(scan, out.schema)
    return out.mapInArrow(lambda batches: then(scan(batches)), schema)


def hit_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (word ranges hit, disjoint, sorted) and items of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_hits(rows, benchmark, "text", window, ["n_words", "hits", "items"]).drop("text")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Digest columns of :func:`hit_spans`: counts, and the items as one checksum."""
    spans = hit_spans(docs, benchmark, **options)
    length = F.aggregate("hits", F.lit(0).cast("long"),
                         lambda acc, x: acc + (x["hi"] - x["lo"]).cast("long"))
    return spans.select(
        "doc_id", "n_words", length.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
           drop_share: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages; every column is kept.

    The hit words are cut out of the text. A document of which ``drop_share`` of the words or
    more are hit is dropped whole: what is left of it is not a text of its own.
    """
    names = free_name(docs, "n_words", "hits", "items")
    at, n_columns, schema = docs.columns.index("text"), len(docs.columns), docs.schema

    def cut_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:n_columns]
            n_words, hits = batch.column(n_columns).to_pylist(), batch.column(n_columns + 1)
            texts, hits = columns[at].to_pylist(), hits.to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for a, b, data, off in B.chunks(columns[at]):
                if not any(hits[a:b]):
                    continue
                start, end, _, first = B.words(data, off, B.ALNUM_WORDS)
                for i in range(b - a):
                    spans = [(x["lo"], x["hi"]) for x in hits[a + i]]
                    if spans and sum(y - x for x, y in spans) >= drop_share * n_words[a + i]:
                        keep[a + i] = False
                    elif spans:
                        raw, parts, left = data[off[i]:off[i + 1]].tobytes(), [], 0
                        for x, y in spans:
                            parts.append(raw[left:int(start[first[i] + x] - off[i])])
                            left = int(end[first[i] + y - 1] - off[i])
                        texts[a + i] = b"".join([*parts, raw[left:]]).decode("utf-8", "replace")
            columns[at] = pa.array(texts, columns[at].type)
            done = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n_columns])
            yield done.filter(pa.array(keep))

    return _with_hits(docs, benchmark, "text", window, names, cut_hits, schema)

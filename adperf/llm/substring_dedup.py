"""Repeated passages by sliding spans of consecutive sentences.

A sentence ends at ``. ! ?`` or a line break; a long sentence is also cut after words whose hash
says so, and where ``GAP`` words follow each other without either, after the smallest hash of
them (all words that share it). Both rules look at these words alone, so of any ``GAP`` words of
a passage one ends a sentence, the same in every copy: equal passages are cut alike from the first
such word to the last, and any ``4 * GAP`` equal words hold a span. A run of at least ``SENTENCES`` consecutive sentences with at least ``WORDS`` words is
repeated where the same words, cut alike, stand before it in (doc_id, position). Of these runs the
shortest from each sentence on and the shortest up to each sentence are spans: together they cover
every sentence of every longer run, and they repeat where it does. Spans are hashed by their
lower-cased words (96 bits), joined over all documents, and the sentences of every span that is
not its hash's first occurrence are removed. A first occurrence stays, so one copy of every
passage is kept.

Skew: first occurrences are a minimum with map-side combine; the join back is an equi-join that
AQE may split, so a passage in a third of all documents meets no single task.

Edge cases: null and empty texts have no sentence; texts without a long enough run have no span
and stay as they are; rows that repeat an id are one document; a null id is never removed from;
texts of any length are cut whole; of equal spans the one first in (doc_id, position) stays; an
empty table gives no rows; other columns are not read by :func:`repeated_spans` and are carried by :func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .tables import bounded_batches, cut, free_name

SENTENCES = 3
WORDS = 16
SOFT_CUT = 16  # a word in so many ends a sentence by its hash
GAP = 12  # the most words without an end: 50 words hold the four ends around three sentences

ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def smallest_of_windows(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether each word has the smallest hash of some ``GAP`` words without a head after the
    first of them."""

    def sliding(x: np.ndarray, of) -> np.ndarray:
        wide = 1
        while 2 * wide <= GAP:
            x = of(x[:-wide], x[wide:])
            wide *= 2
        return of(x[:len(x) - GAP + wide], x[GAP - wide:]) if GAP > wide else x

    if len(h) < GAP:
        return np.zeros(len(h), bool)
    part = np.cumsum(heads)
    # 0 stands for a window that is not whole and is the smallest of no word
    low = np.where(part[GAP - 1:] == part[:len(h) - GAP + 1],
                   sliding(np.maximum(h, B.U64(1)), np.minimum), B.U64(0))
    none = np.zeros(GAP - 1, B.U64)
    return sliding(np.concatenate([none, low, none]), np.maximum) == np.maximum(h, B.U64(1))


def sentence_spans(data: np.ndarray, off: np.ndarray):
    """Byte start and end of each sentence's words, each document's first sentence, and the
    spans: first sentence, end sentence, two hashes."""
    start, end, h, first = B.words(data, off, B.ALNUM_WORDS)
    n = len(start)
    # terminators up to each place tell whether one stands between two words
    stops = np.concatenate([[0], np.cumsum(ENDS[data])])
    heads = np.ones(n, bool)
    if n:
        between = stops[start[1:]] > stops[end[:-1]]
        heads[1:] = between | (h[:-1] % B.U64(SOFT_CUT) == 0)
        heads[first[:-1][first[:-1] < n]] = True
        heads[1:] |= smallest_of_windows(h, heads)[:-1]
    head = np.flatnonzero(heads)
    tail = np.append(head[1:], n)[:len(head)]
    doc_first = np.searchsorted(head, first)
    # prefix sums of word hashes: the hash of any run of words
    up, down = B.powers(n + 1)
    sums = [np.concatenate([np.zeros(1, B.U64), np.cumsum(x * up[:n])])
            for x in (h, B.mix(h ^ B.U64(0x5851F42D4C957F2D)))]
    # the shortest run from each sentence with enough sentences and enough words
    at = np.arange(len(head))
    last = np.maximum(at + SENTENCES - 1,
                      np.searchsorted(tail, (head if len(head) else tail) + WORDS))
    doc_of = np.repeat(np.arange(len(off) - 1), np.diff(doc_first))
    ok = last < (doc_first[1:][doc_of] if len(head) else 0)
    a, z = np.flatnonzero(ok), last[ok]
    # and the shortest up to each sentence, where it is not one of those
    start_at = np.minimum(at - SENTENCES + 1,
                          np.searchsorted(head, tail - WORDS, side="right") - 1)
    up_to = np.flatnonzero(start_at >= (doc_first[doc_of] if len(head) else 0))
    up_to = up_to[last[start_at[up_to]] != up_to]
    a, z = np.concatenate([a, start_at[up_to]]), np.concatenate([z, up_to])
    count = (tail[z] - head[a]).astype(B.U64)
    hashes = [B.mix((s[tail[z]] - s[head[a]]) * down[head[a]] ^ count) for s in sums]
    return start[head], end[tail - 1] if len(head) else tail, doc_first, a, z, doc_of, hashes


def spans(docs: DataFrame) -> DataFrame:
    """One row per span of (doc_id, text) rows: two hashes, byte range, sentence count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a0, b0, data, off in B.chunks(batch.column(1)):
                lo, hi, _, a, z, doc_of, (h1, h2) = sentence_spans(data, off)
                ids = batch.column(0).slice(a0, b0 - a0)
                doc = doc_of[a]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), pa.array(B.as_long(h1)),
                     pa.array((h2 >> B.U64(33)).astype(np.int32)),
                     pa.array((lo[a] - off[doc]).astype(np.int32)),
                     pa.array((hi[z] - off[doc]).astype(np.int32)),
                     pa.array((z - a + 1).astype(np.int32))],
                    names=["doc_id", "h1", "h2", "lo", "hi", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, h1 long, h2 int, lo int, hi int, sentences int")


def sentence_counts(docs: DataFrame) -> DataFrame:
    """doc_id and number of sentences of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(sentence_spans(data, off)[2])
                 for _, _, data, off in B.chunks(batch.column(1))]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_sentences"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_sentences long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the byte ranges (disjoint, sorted) that non-first repeated spans cover."""
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spans(docs.where(F.col("doc_id").isNotNull()))
    at = F.struct("doc_id", "lo")
    first = (found.groupBy("h1", "h2")
             .agg(F.min(at).alias("first"), F.max(at).alias("last"))
             .where(F.col("first") != F.col("last"))
             .select("h1", "h2", F.col("first.doc_id").alias("d0"), F.col("first.lo").alias("l0")))
    # as a written table it is a plain side of the join, which AQE can split at a hot passage
    again = found.join(cut(first, "op10-first"), ["h1", "h2"]).where(
        (F.col("doc_id") != F.col("d0")) | (F.col("lo") != F.col("l0")))
    ranges = (again.groupBy("doc_id")
              .agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges")))
    none = F.expr("CAST(array() AS array<struct<lo: int, hi: int>>)")
    merged = F.aggregate(
        "ranges", none,
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= r["lo"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["lo"].alias("lo"),
                F.greatest(F.element_at(acc, -1)["hi"], r["hi"]).alias("hi")))))
        .otherwise(F.concat(acc, F.array(r))))
    return ranges.select("doc_id", merged.alias("ranges"))


def report(docs: DataFrame) -> DataFrame:
    """Every row with its sentence count, the bytes and number of passages removed, and the
    byte ranges of those passages in the UTF-8 text."""
    ranges = cut(repeated_spans(docs), "op10-ranges")
    rows = sentence_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    none = F.expr("CAST(array() AS array<struct<lo: int, hi: int>>)")
    size = F.aggregate("removed", F.lit(0).cast("long"),
                       lambda acc, r: acc + (r["hi"] - r["lo"]).cast("long"))
    return (rows.join(ranges, "doc_id", "left")
            .withColumn("removed", F.coalesce("ranges", none))
            .select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"),
                    size.alias("n_bytes_removed"), "removed"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; all columns are kept."""
    (name,) = free_name(docs, "ranges")
    ranges = repeated_spans(docs).withColumnRenamed("ranges", name)
    joined = docs.join(ranges, "doc_id", "left").select(*docs.columns, name)
    at, schema = docs.columns.index("text"), docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, ranges in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if ranges:
                    raw, parts, left = texts[i].encode(), [], 0
                    for r in ranges:
                        parts.append(raw[left:r["lo"]])
                        left = r["hi"]
                    texts[i] = b"".join([*parts, raw[left:]]).decode("utf-8", "replace")
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(clean, schema)

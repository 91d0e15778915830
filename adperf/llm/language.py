"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of byte n-grams (one to three bytes of the lower-case
UTF-8 text, everything but letters folded to a space, hashed to ``DIM`` columns). Each language
is several centroids, found by spherical k-means among its training vectors. A text gets the
language of the centroid with the largest cosine; the cosine is the score. A text too far from
every centroid is rejected.

The classifier is fitted on a bounded sample: about ``PER_LANGUAGE`` texts of each of the
``MAX_LANGUAGES`` commonest labels, whole texts of any length, picked by a hash of the id, so the
sample and the model do not depend on partitioning. The fit runs in tasks: texts become sparse
vectors where they are read, document frequencies are an aggregate, and each language's centroids
come from one task that holds its sample alone. The driver gets frequencies and centroids, no
text and no vector. Prediction reads whole texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
when there is nothing to learn from; equal cosines go to the language first in name order; rows
are returned one by one, repeated ones too (of rows that repeat an id and a label one is learned
from, by a hash of its text); texts of any length are learned from and scored whole; an empty
table gives no rows; extra columns are carried by :func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .tables import bounded_batches, cut, discard, free_name

DIM_BITS = 12
DIM = 1 << DIM_BITS
NGRAMS = (1, 2, 3)
PER_LANGUAGE = 1_500
MAX_LANGUAGES = 1_000
CENTROIDS = 4
ROUNDS = 12
# a text is rejected below this share of the 0.1 % quantile of the training cosines; a text of
# fewer letters than FULL_LETTERS says less and must be that much farther away
REJECT_SHARE = 0.5
FULL_LETTERS = 100
UNDETERMINED = "und"
ROWS_AT_ONCE = 256

LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part


def _columns(grams: np.ndarray, n: int) -> np.ndarray:
    return ((grams * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - DIM_BITS)
            ).astype(np.int64)


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-scaled n-gram counts of each text, one row per text."""
    n_docs = len(off) - 1
    b = LETTERS[data].astype(np.uint32)
    counts = np.zeros(n_docs * DIM, np.float32)
    length = np.diff(off)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64) * DIM, length)
    left = np.repeat(off[1:], length) - np.arange(len(data))  # bytes to the text's end
    gram = np.zeros(len(b), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(256) + b[n - 1:]
        if n in NGRAMS:
            # grams of spaces only tell nothing
            ok = (left[:m] >= n) & (gram != np.uint32(int.from_bytes(b" " * n, "big")))
            counts += np.bincount(doc[:m][ok] + _columns(gram[ok], n), minlength=n_docs * DIM)
    return np.log1p(counts).reshape(n_docs, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def _texts(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(text, ""))


def _spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` unit centroids; seeds are picked far apart, starting at the mean."""
    seeds = [_unit(x.mean(axis=0, keepdims=True))[0]]
    near = x @ seeds[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j]
                            for j in range(len(c))]))
    return c


def bounded_sample(rows: DataFrame, label: str, per_label: int, max_labels: int) -> DataFrame:
    """About ``per_label`` rows (doc_id, label) of each of the ``max_labels`` commonest labels.

    Rows are taken by a threshold on a hash of the id that each label's count sets, so no
    label is gathered or sorted; a limit above the expected size makes the bound hold always.
    """
    counts = (rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), label).limit(max_labels))
    cells = 1 << 40
    cut = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("n")) * F.lit(float(cells))
    chosen = rows.join(F.broadcast(counts), label)
    return (chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(cells)) < cut)
            .select("doc_id", label).distinct().limit(2 * per_label * max_labels))


def sample(train: DataFrame) -> DataFrame:
    """About ``PER_LANGUAGE`` rows (lang, text) of each language, picked by the id's hash."""
    usable = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = bounded_sample(usable.select("doc_id", "lang"), "lang", PER_LANGUAGE, MAX_LANGUAGES)
    # the size is bounded by the sample's parameters
    rows = usable.join(F.broadcast(ids), ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))


VECTOR = "doc_id long, lang string, at array<int>, value array<float>"


def _vectors(rows: DataFrame) -> DataFrame:
    """The log-scaled counts of (doc_id, lang, text) rows that are not zero."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.chunks(_texts(batch.column(2)), ROWS_AT_ONCE):
                x = term_counts(data, off)
                row, at = np.nonzero(x)
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v))
                         for v in (at.astype(np.int32), x[row, at])]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:2]), *lists],
                    names=["doc_id", "lang", "at", "value"])

    rows = bounded_batches(rows.select(F.col("doc_id").cast("long"), "lang", "text"))
    return rows.mapInArrow(scan, VECTOR).where(F.size("at") > 0)


def _weighted(at: pa.Array, value: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of a batch of sparse rows."""
    x = np.zeros((len(at), DIM), np.float32)
    n = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    x[np.repeat(np.arange(len(at)), n), at.flatten().to_numpy(zero_copy_only=False)] = (
        value.flatten().to_numpy(zero_copy_only=False))
    x *= idf
    return _unit(x)


def fit(train: DataFrame) -> dict:
    """Model from labelled rows: idf, centroids, their languages, rejection cosine."""
    context = train.sparkSession.sparkContext
    vectors = cut(_vectors(sample(train)), "language-sample")
    n = vectors.count()
    if not n:
        discard(vectors)
        return {"langs": [], "idf": None, "centroids": None, "reject": 0.0}
    df = np.zeros(DIM)
    for r in vectors.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        df[r["at"]] = r["count"]  # a row for each of DIM columns at most
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    shared = context.broadcast(idf)

    def centroids_of(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        at, value = (table.column(c).combine_chunks() for c in ("at", "value"))
        c = _spherical_kmeans(_weighted(at, value, shared.value), CENTROIDS).astype(np.float32)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c)),
                         "place": pa.array(np.arange(len(c))),
                         "c": pa.array([row.tobytes() for row in c], pa.binary())})

    found = sorted(vectors.groupBy("lang").applyInArrow(
        centroids_of, "lang string, place long, c binary").collect())
    centroids = np.stack([np.frombuffer(r.c, np.float32) for r in found])
    model = context.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                x = _weighted(part.column(0), part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((x @ model.value.T).max(axis=1).astype(np.float64))], names=["best"])

    best = vectors.select("at", "value").mapInArrow(nearest, "best double")
    low = best.agg(F.percentile("best", F.lit(0.001))).first()[0]
    discard(vectors)
    return {"langs": [r.lang for r in found], "idf": idf, "centroids": centroids,
            "reject": REJECT_SHARE * low}


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _predict(text: pa.Array, model: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a batch."""
    n = len(text)
    langs, score = [UNDETERMINED] * n, np.zeros(n)
    rejected = np.ones(n, bool)
    if not model["langs"]:
        return langs, score, rejected
    names = np.array(model["langs"], object)
    ascii_letter = pc.fill_null(
        pc.match_substring_regex(text, "[A-Za-z]"), False)
    letter = ascii_letter.to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~letter):
        letter[i] = _has_letter(text[int(i)].as_py())
    # lower-casing can change a text's length, so offsets come from the lowered text
    for a, b, data, off in B.chunks(_texts(text), ROWS_AT_ONCE):
        x = _unit(term_counts(data, off) * model["idf"])
        cosine = x @ model["centroids"].T
        best = cosine.argmax(axis=1)
        value = np.clip(cosine[np.arange(b - a), best], 0.0, 1.0)
        known = letter[a:b]
        letters = np.concatenate([[0], np.cumsum(LETTERS[data] != 0x20)])
        share = np.minimum(1.0, np.diff(letters[off]) / FULL_LETTERS)
        score[a:b] = np.where(known, value, 0.0)
        rejected[a:b] = ~known | (value < model["reject"] * share)
        for i in np.flatnonzero(known):
            langs[a + int(i)] = names[best[i]]
    return langs, score, rejected


def add_language(docs: DataFrame, model: dict, text_col: str, names: list[str]) -> DataFrame:
    """``docs`` and three columns: language, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = bounded_batches(docs)
    out = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]),
                      F.lit(False).alias(names[2]))
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rejected = _predict(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(langs, pa.string()), pa.array(score),
                 pa.array(rejected)], names=batch.schema.names)

    return out.mapInArrow(predict, out.schema)


def report(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Predictions for every row, learned only from rows outside the held-out fold."""
    out = held_out(F.col("doc_id"), folds, fold)
    model = fit(docs.where(~out).select("doc_id", "lang", "text"))
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    found = add_language(rows, model, "text", ["lang_pred", "score", "rejected"])
    return found.drop("text")


def keep_known(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Rows of ``docs`` whose language is recognised; all columns are kept."""
    train = docs.where(~held_out(F.col("doc_id"), folds, fold))
    model = fit(train.select("doc_id", "lang", "text"))
    names = free_name(docs, "lang_pred", "score", "rejected")
    found = add_language(docs, model, "text", names)
    return found.where(~F.col(names[2])).select(docs.columns)

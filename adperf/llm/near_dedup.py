"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Every document is its set of distinct word shingles and a signature of ``COORDINATES`` minwise
tokens. Equal sets become one class first, so copies cost nothing further. Then ``TREES``
independent trees branch the classes: the root of tree t sends a class to the child named by
its t-th token; a deeper node picks by its own path which coordinates to branch on (one, or two
with chance ``SECOND_CHILD``, so that a pair at the threshold is expected to stay together in
more than one child). A node of at most ``SMALL`` classes is compared exhaustively; in a larger
one all classes are compared with the node's smallest and it branches on. Two classes share a
root child with the chance of their similarity, so a pair at the threshold s is missed by all
trees with chance (1 - s) ** TREES (6e-9 at 0.85, 1e-7 at 0.8).

Candidates pass a size test (exact) and a signature test far below the threshold (half of the
tokens equal), and each is confirmed on the full sets, which are made of these classes only.
Large nodes whose classes are already one component after the first level are dropped: they
cannot change the result. What is still large after ``MAX_DEPTH`` levels goes through an exact
rarest-token filter instead of being compared exhaustively, so a large family of near-copies
costs no square of its size.

Skew: node sizes and smallest classes are aggregates with map-side combine; branching is an
expression per row; only nodes of at most ``SMALL`` classes are gathered.

Edge cases: null, empty or wordless texts have an empty set and link with nothing; texts with
fewer words than a shingle are one shingle of all their words; repeated rows are returned one
by one; rows with a null id link with nothing; equal sets are one class whatever their texts, the
smallest id naming it, so there are no ties; texts of any length are taken whole, chunk by chunk;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .components import connected_components
from .tables import bounded_batches, cut, discard

COORDINATES = 32
TREES = 10
SMALL = 16
SECOND_CHILD = 0.3
MAX_DEPTH = 4
SIGNATURE_SHARE = 0.5
BUCKETS = 1 << 20
ID_BITS = 1 << 24

_rng = np.random.default_rng(41)
_FLIP = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    _, _, h, first = B.words(data, off, B.SPACE_WORDS)
    full = B.runs_hash(h, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(full[lo:hi - k + 1]))
        else:
            out.append(B.runs_hash(h[lo:hi], hi - lo) if hi > lo else full[:0])
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens (n x COORDINATES, int32) and two 64-bit set keys of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    tokens, at = np.concatenate(sets), np.cumsum(sizes) - sizes
    sig = np.empty((len(sets), COORDINATES), np.int32)
    for i in range(COORDINATES):
        low = np.minimum.reduceat((tokens ^ _FLIP[i]) * _TIMES[i], at)
        sig[:, i] = (low >> np.uint64(16)).astype(np.uint32).view(np.int32)
    keys = np.stack([np.add.reduceat(B.mix(tokens ^ _FLIP[i]), at) for i in (0, 1)], axis=1)
    return sig, keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set keys and signature of each (doc_id, text) row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.chunks(batch.column(1)):
                sets = shingle_sets(data, off, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                sig = np.zeros((b - a, COORDINATES), np.int32)
                keys = np.zeros((b - a, 2), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    sig[some], keys[some] = _signatures([sets[i] for i in some])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (b - a + 1) * COORDINATES, COORDINATES, np.int32)),
                    pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(keys[:, 0]),
                     pa.array(keys[:, 1]), lists],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.mapInArrow(
        scan, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(cls, tokens) of the given (doc_id, text) rows; tokens are sorted 64-bit hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.chunks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, off, shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())],
                    names=["cls", "tokens"])

    return docs.mapInArrow(scan, "cls long, tokens binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x = np.frombuffer(ta[i].as_buffer(), np.uint64)
                y = np.frombuffer(tb[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(test, "a long, b long")


def _similar_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that pass the size test and the signature test."""
    one = classes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"),
                         F.col("sig").alias("sa"))
    two = classes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"),
                         F.col("sig").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0),
                       lambda acc, x: acc + x)
    sized = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return (pairs.join(one, "a").join(two, "b").where(sized)
            .where(same >= F.lit(int(COORDINATES * SIGNATURE_SHARE))).select("a", "b"))


def _children(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Branch rows (key, cls, label): the path picks the coordinates of the signature, which
    meets a class once, with all its nodes."""
    rows = (rows.groupBy("cls").agg(F.first("label").alias("label"),
                                    F.collect_list("key").alias("keys"))
            .join(sigs, "cls").select(F.explode("keys").alias("key"), "cls", "label", "sig"))

    def child(j: int) -> Column:
        coordinate = F.pmod(F.xxhash64("key", F.lit(j)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64("key", F.lit(j), F.element_at("sig", coordinate + 1))

    second = F.pmod(F.xxhash64("key", F.lit("second")), F.lit(1000)) < int(1000 * SECOND_CHILD)
    keys = F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0)))
    return rows.select(F.explode(keys).alias("key"), "cls", "label")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (key, cls, label) with their node's size, smallest class and label range."""
    nodes = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("cls", "label")).alias("least"),
        F.min("label").alias("l0"), F.max("label").alias("l1"))
    mixed = nodes.where((F.col("size") > 1) & (F.col("l0") != F.col("l1"))).drop("l0", "l1")
    # as a written table it is a plain side of the join, which AQE can split at a large node
    return rows.join(cut(mixed, "near-sizes"), "key")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different labels inside nodes of at most ``SMALL`` classes."""
    m = F.sort_array(F.collect_list(F.struct("cls", "label")))
    nodes = (rows.where(F.col("size") <= SMALL).groupBy("key").agg(m.alias("m"))
             .select("m", F.explode("m").alias("x")))
    return (nodes.select(F.col("x.cls").alias("a"), F.col("x.label").alias("la"),
                         F.explode(F.filter("m", lambda y: (y["cls"] > F.col("x.cls"))
                                            & (y["label"] != F.col("x.label")))).alias("y"))
            .select("a", F.col("y.cls").alias("b")))


def _star_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with the smallest class inside larger nodes."""
    far = (F.col("size") > SMALL) & (F.col("cls") != F.col("least.cls")) & (
        F.col("label") != F.col("least.label"))
    return rows.where(far).select(F.col("least.cls").alias("a"), F.col("cls").alias("b"))


def _token_counts(sets: DataFrame) -> np.ndarray:
    """How many tokens of all ``sets`` fall in each of ``BUCKETS`` buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for tokens in batch.column(1):
                held += np.bincount(_bucket(np.frombuffer(tokens.as_buffer(), np.uint64)),
                                    minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "n"])

    counts = sets.mapInArrow(scan, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    found = counts.toArrow()  # a row for each bucket at most
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (B.mix(tokens) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _prefix_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels, among all classes of ``rows``, that can reach the threshold.

    An exact filter: with the tokens of every set in one order, two sets that reach the
    threshold have their first common token so early in both that what follows is large enough
    for the overlap needed. Any order is exact; this one puts the rarest first, by the tokens
    counted in ``BUCKETS`` buckets (a table of one size, however many tokens there are). The
    edits of a near-copy are its rarest tokens, so members of one family below the threshold do
    not meet.
    """
    classes = rows.select("cls", "label").distinct()
    sets = cut(sets.join(classes, "cls").select("cls", "tokens", "label"), "near-large")
    counts = sets.sparkSession.sparkContext.broadcast(_token_counts(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, tokens, sizes, places = [], [], [], []
            for i, blob in enumerate(batch.column(1)):
                t = np.frombuffer(blob.as_buffer(), np.uint64)
                n, df = len(t), counts.value[_bucket(t)]
                most = n - (percent * n + 99) // 100 + 1
                order = np.lexsort((t, df))[:most]
                at = np.flatnonzero(df[order] > 1)  # a token alone in its bucket meets none
                keep.append(np.full(len(at), i))
                tokens.append(t[order[at]].view(np.int64))
                sizes.append(np.full(len(at), n))
                places.append(at + 1)
            if keep:
                index = pa.array(np.concatenate(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), batch.column(0).take(index),
                     batch.column(2).take(index), pa.array(np.concatenate(sizes)),
                     pa.array(np.concatenate(places))], names=["token", "cls", "label", "n", "at"])

    first = cut(sets.mapInArrow(prefixes, "token long, cls long, label long, n long, at long"),
                "near-prefix")
    common = (first.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
              .where(F.col("l0") != F.col("l1")).select("token", "l0"))
    y = first.join(cut(common, "near-common"), "token")
    # of two labels one is not the token's smallest: that side is usually the small one
    x = y.where(F.col("label") != F.col("l0")).select(
        "token", *[F.col(c).alias(f"{c}_x") for c in ("cls", "label", "n", "at")])
    overlap = F.least(F.col("n") - F.col("at"), F.col("n_x") - F.col("at_x")) + F.lit(1)
    enough = (F.lit(100 + percent) * overlap >= F.lit(percent) * (F.col("n") + F.col("n_x")))
    pairs = x.join(y, "token").where((F.col("label") != F.col("label_x")) & enough)
    return pairs.select(F.least("cls", "cls_x").alias("a"), F.greatest("cls", "cls_x").alias("b"))


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (doc_id), and few others: a bit table of one size, however
    many ids there are, is met by every row where it lies."""

    def at(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(ID_BITS))

    maps = ids.groupBy(F.bitmap_bucket_number(at("doc_id")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at("doc_id"))).alias("bits"))
    bit = F.bitmap_bit_position(at("doc_id"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    marked = F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1
    return (docs.withColumn("bucket", F.bitmap_bucket_number(at("doc_id")))
            .join(F.broadcast(maps), "bucket").where(marked).select("doc_id", "text"))


def _set_table(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Full sets of the classes ``ids`` (cls), in one pass over the texts; only the texts that
    are needed are shuffled."""
    ids = ids.select(F.col("cls").alias("doc_id")).distinct()
    # the same plan at every size (an inner join: a semi join is moved below the marks); an id on
    # several rows names equal texts, one is enough
    texts = (_marked(docs, ids).join(ids.hint("merge"), "doc_id")
             .dropDuplicates(["doc_id"]).select("doc_id", "text"))
    return cut(_full_sets(texts, shingle), "near-sets", heavy=True)


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """:func:`_confirm` with the full sets of the classes in ``pairs`` and of no others."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(
        pairs.select(F.col("b").alias("cls")))
    sets = _set_table(docs, ends, shingle)
    links = cut(_confirm(pairs, sets, percent), "near-links", heavy=True)
    discard(sets)
    return links


def similarity_links(docs: DataFrame, classes: DataFrame, shingle: int,
                     percent: int) -> DataFrame:
    """Links (a, b) between classes, enough of them to connect all that are similar."""
    roots = F.array(*[F.xxhash64(F.lit(f"tree {t}"), F.element_at("sig", t + 1))
                      for t in range(TREES)])
    rows = classes.select(F.explode(roots).alias("key"), "cls", F.col("cls").alias("label"))
    rows = cut(_sized(rows), "near-nodes")
    pairs = _small_pairs(rows).unionByName(_star_pairs(rows)).distinct()
    pairs = cut(_similar_enough(pairs, classes, percent), "near-pairs")
    rows = rows.where(F.col("size") > SMALL).select("key", "cls")
    links = _confirmed(pairs, docs, shingle, percent)
    if not rows.head(1):
        return links
    parts = connected_components(links)
    rows = (rows.join(parts.withColumnRenamed("node", "cls"), "cls", "left")
            .select("key", "cls", F.coalesce("component", "cls").alias("label")))
    rows = cut(_sized(rows).select("key", "cls", "label"), "near-mixed")
    sigs, later = classes.select("cls", "sig"), []
    for _ in range(MAX_DEPTH):
        if not rows.head(1):
            break
        rows = cut(_sized(_children(rows, sigs)), "near-level")
        later.append(_small_pairs(rows).unionByName(_star_pairs(rows)))
        rows = rows.where(F.col("size") > SMALL).select("key", "cls", "label")
    else:
        if rows.head(1):
            sets = _set_table(docs, rows.select("cls"), shingle)
            later.append(_prefix_pairs(rows, sets, percent))
    if not later:
        return links
    pairs = reduce(DataFrame.unionByName, later).distinct()
    pairs = cut(_similar_enough(pairs, classes, percent), "near-pairs")
    return links.unionByName(_confirmed(pairs, docs, shingle, percent))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of (doc_id, text, ...).

    Rows are linked when 100 * |intersection| >= percent * |union|; ``component_id`` is the
    smallest id reachable, and that row is kept.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = cut(signatures(docs, shingle), "near-signatures")
    full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    sets = ["n_shingles", "k1", "k2"]
    classes = (sigs.where(full).groupBy(*sets)
               .agg(F.min(F.struct("doc_id", "sig")).alias("m"))
               .select(*sets, F.col("m.doc_id").alias("cls"), F.col("m.sig").alias("sig")))
    classes = cut(classes, "near-classes")
    links = similarity_links(docs, classes, shingle, percent)
    parts = connected_components(links).withColumnRenamed("node", "cls")
    named = (classes.select(*sets, "cls").join(parts, "cls", "left")
             .select(*sets, F.coalesce("component", "cls").alias("component_id")))
    linked = sigs.where(full).join(named, sets).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where(~F.coalesce(full, F.lit(False))).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns are kept.

    Rows that repeat a kept id are copies of each other and stay one row.
    """
    lost = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select("doc_id")
    return docs.join(lost.distinct(), "doc_id", "left_anti").select(docs.columns)

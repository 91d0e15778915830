"""Line dedup by a suffix array over line ids, with built-in functions only.

Every document is a sequence of line ids (blank lines are left out). A run of 2**k lines is
named by its first occurrence (doc_id, position) in the corpus. Prefix doubling: the runs of
2**(k+1) lines are grouped by the names of their two halves, and each group's smallest
occurrence is its name, so names are exact and suffixes with one name form an interval whose
longest common prefix is at least 2**k. Suffixes that are alone in their group are resolved and
leave; the rounds end when none is tied. The tied suffixes of all rounds give the maximal
repeated runs; in every interval all but the first occurrence are later copies, and the lines
that later copies cover are deleted. A run counts from ``MIN_LINES`` lines on, or as a single
line of at least ``LONG_LINE`` characters.

Skew: the first occurrences are aggregates with map-side combine, joined back by an equi-join
that AQE may split. The step to the second half is a range frame inside a document. Only lines
that occur twice or more take part after the first aggregate.

Edge cases: null and empty texts have no lines; rows that repeat an id are one document (its
lines are taken once); rows with a null id keep all lines; lines are compared whole but for
trailing spaces, however long the text or the line; of equal runs the one first in (doc_id,
position) stays; an empty table gives no rows; other columns are not read by :func:`repeated_runs` and are carried
by :func:`remove_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, free_name

MIN_LINES = 2
LONG_LINE = 40


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, pos (line number), seq (number among non-blank lines), two hashes, length."""
    lines = F.transform(lines_of(F.col("text")),
                        lambda x, i: F.struct(F.rtrim(x).alias("line"), i.alias("pos")))
    rows = (docs.where(F.col("doc_id").isNotNull())
            .select("doc_id", F.posexplode(F.filter(lines, lambda s: s["line"] != ""))
                    .alias("seq", "s")))
    return rows.select("doc_id", "seq", F.col("s.pos").alias("pos"),
                       F.xxhash64("s.line").alias("h1"),
                       F.xxhash64(F.lit("line"), "s.line").alias("h2"),
                       F.length("s.line").alias("chars"))


def _tied(rows: DataFrame, keys: list[str], hot: bool = False) -> DataFrame:
    """Rows whose key occurs twice or more, with their group's first occurrence as name.

    With ``hot`` the groups are a written table, a plain side of the join that AQE can split at
    a line in a third of all documents.
    """
    at = F.struct("doc_id", "seq")
    groups = (rows.groupBy(*keys).agg(F.min(at).alias("name"), F.max(at).alias("other"))
              .where(F.col("name") != F.col("other"))
              .select(*keys, F.col("name.doc_id").alias("name_doc"),
                      F.col("name.seq").alias("name_seq")))
    return rows.join(cut(groups, "line-groups") if hot else groups, keys)


def tied_suffixes(docs: DataFrame) -> list[DataFrame]:
    """The suffixes still tied after each round of doubling, as written tables.

    Columns: doc_id, seq, pos and end (first and last line of the run), chars, name_doc and
    name_seq (the run's first occurrence).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keep = ["doc_id", "seq", "pos", "end", "chars", "name_doc", "name_seq"]
    rows = _line_rows(docs).withColumn("end", F.col("pos"))
    rows = _tied(rows, ["h1", "h2"], hot=True).select(*keep)
    levels, step = [cut(rows, "lines-1")], 1
    while levels[-1].head(1):
        later = (Window.partitionBy("doc_id").orderBy("seq").rangeBetween(step, step))
        rows = levels[-1].select(
            "doc_id", "seq", "pos", F.max("end").over(later).alias("end"), "chars",
            F.col("name_doc").alias("a_doc"), F.col("name_seq").alias("a_seq"),
            F.max("name_doc").over(later).alias("b_doc"),
            F.max("name_seq").over(later).alias("b_seq"))
        rows = rows.where(F.col("b_doc").isNotNull())
        step *= 2
        levels.append(cut(_tied(rows, ["a_doc", "a_seq", "b_doc", "b_seq"]).select(*keep),
                          f"lines-{step}"))
    return levels


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the maximal runs of lines (lo, hi: first and last line) that are later copies
    of runs that stand earlier, each with the depth at which it is still tied at some line."""
    covers = None
    for k, level in enumerate(tied_suffixes(docs)):
        copies = level.where((F.col("doc_id") != F.col("name_doc"))
                             | (F.col("seq") != F.col("name_seq")))
        if 2 ** k < MIN_LINES:
            copies = copies.where(F.col("chars") >= LONG_LINE)
        copies = copies.select("doc_id", F.col("pos").alias("lo"), F.col("end").alias("hi"),
                               F.lit(2 ** k).alias("depth"))
        covers = copies if covers is None else covers.unionByName(copies)
    # the deepest cover of each start says it all; then overlapping covers are merged
    covers = covers.groupBy("doc_id", "lo").agg(F.max("hi").alias("hi"),
                                                F.max("depth").alias("depth"))
    order = Window.partitionBy("doc_id").orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    return (covers.withColumn("new", new).withColumn("run", F.sum("new").over(order))
            .groupBy("doc_id", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                          F.max("depth").alias("depth")).drop("run"))


def _per_document(docs: DataFrame) -> DataFrame:
    runs = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    return repeated_runs(docs).groupBy("doc_id").agg(runs.alias("runs"),
                                                     F.max("depth").alias("depth"))


def report(docs: DataFrame) -> DataFrame:
    """Every row with its lines, deleted lines, number and depth of repeated runs."""
    runs = _per_document(docs)
    none = F.expr("CAST(array() AS array<struct<lo: int, hi: int>>)")
    blank = F.transform(lines_of(F.col("text")), lambda x: F.trim(x) == "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.size(F.filter(blank, lambda x: ~x)).cast("long").alias("n_lines"))
    size = F.aggregate("runs", F.lit(0).cast("long"),
                       lambda acc, r: acc + (r["hi"] - r["lo"] + 1).cast("long"))
    return (rows.join(runs, "doc_id", "left").withColumn("runs", F.coalesce("runs", none))
            .select("doc_id", "n_lines", F.size("runs").cast("long").alias("n_runs"),
                    size.alias("n_deleted"),
                    F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "runs"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of later copies; all columns are kept.

    A document of which no line is left is dropped; its lines all stand in others.
    """
    (name,) = free_name(docs, "runs")
    runs = _per_document(docs).select("doc_id", F.col("runs").alias(name))
    joined = docs.join(runs, "doc_id", "left")
    kept = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.exists(F.col(name), lambda r: (s["i"] >= r["lo"]) & (s["i"] <= r["hi"])))
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    gone = F.col(name).isNotNull() & (F.trim(F.regexp_replace("text", "\\s", "")) == "")
    return joined.withColumn("text", text).where(~gone).select(docs.columns)

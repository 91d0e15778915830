"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns
a DataFrame that is written and read again as the next one's ``docs``. All stages but the last
return the columns of ``documents``:

1. language ID: documents whose language is not recognised go;
2. line dedup: lines that later copies of repeated runs cover are deleted, documents left
   without a line go;
3. MinHash near-dedup (five-word shingles, similarity 0.8): one document of each group stays;
4. benchmark decontamination: benchmark passages are cut out, documents that are mostly
   benchmark go;
5. best-fit packing of what is left into sequences.

Edge cases: null and empty texts have no language, so stage 1 drops them; rows with a null id pass
stages 2 and 3 as they are; rows that repeat an id are treated as each stage's operator says; of
near copies the smallest id stays; texts of any length are taken whole; an empty table gives
no rows; columns beside those of ``documents`` are carried to the last stage, which reads none of
them.

SQL cannot express stages 1, 3 and 5, so ``ORACLE_SQL`` is None and the stages are tested
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adperf.llm import decontaminate, language, line_dedup, near_dedup, packing
from adperf.llm.tables import cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

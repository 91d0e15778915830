import random

import corpus_pipeline as P
from adperf.llm import decontaminate, language, line_dedup, near_dedup
from adperf.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        assert 0 < docs.count() <= before.count(), name
    # each decision holds in what the stages kept
    assert language.report(docs).where("lang_pred = 'und'").count() == 0
    assert near_dedup.near_duplicates(docs).where(~near_dedup.F.col("kept")).count() == 0
    left = decontaminate.report(docs, bench)
    assert left.where("n_hit >= 20").count() == 0
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.count()


def test_run_equals_its_stages(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "piece", "size", "bin"} <= set(got.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    order = ["doc_id", "piece"]
    assert got.orderBy(*order).collect() == docs.orderBy(*order).collect()


def test_stages_take_edge_documents(spark):
    rng = random.Random(1)
    words = "the of and to in that is was for on as with his they be at one have this".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "en", "s", 1) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, "123", "en", "s", 3),
             (53, rows[1][1], "en", "s", 1), (54, rows[1][1] + " to", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = {r.doc_id for r in docs.collect()}
    assert kept == set(range(40))


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_every_operator_is_registered():
    assert [n for n in QUERIES if n.startswith("op")] == sorted(
        (n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(QUERIES) == 11 and line_dedup.MIN_LINES == 2

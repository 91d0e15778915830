"""The registered queries on the smallest tables: contract columns, one row per key, SQL."""

import duckdb
import pytest

from adperf.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint",
                       "kept": "boolean"},
    "op2_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_deleted": "bigint"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string",
                     "score": "double"},
    "op4_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint",
                          "n_items": "bigint", "items_sha256": "string",
                          "contaminated": "boolean"},
    "op5_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint",
                     "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint",
                         "n_spans": "bigint", "kept_sha256": "string"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint",
                        "kept": "boolean", "text_sha256": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double",
                     "predicted": "int"},
    "op10_substring_dedup": {"doc_id": "bigint", "n_sentences": "bigint", "n_removed": "bigint"},
    "op11_conversation_repair": {
        "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint",
        "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string",
        "repaired_sha256": "string"},
    "op12_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string",
                             "root": "string", "proof_sha256": "string",
                             "folded_root": "string", "verified": "boolean"},
    "op13_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint",
                          "over_limit": "boolean"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract_columns_and_one_row_per_key(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    table, key = ("documents", "doc_id") if "doc_id" in types else ("conversations", "conv_id")
    ids = [r[0] for r in df.select(key).collect()]
    rows = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert sorted(ids) == sorted(r[0] for r in (rows if key == "doc_id" else rows.distinct()).collect())


@pytest.mark.parametrize("name", SQL)
def test_sql_gives_the_same_rows(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = con.sql(SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*found.columns).collect())
    assert got == sorted(found.fetchall())

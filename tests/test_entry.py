import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "ctr" in df.columns and "conversion_rate" in df.columns


def test_every_query_has_oracle_or_is_documented():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert set(entry.QUERIES) - set(sqls) == set()


def test_queries_run_on_smoke_tables(spark):
    for name, fn in entry.QUERIES.items():
        df = fn(spark, entry.SMOKE_DIR)
        assert df.count() >= 0, name

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["frontend", "n_docs"]
    assert df.count() > 0 and df.agg({"n_docs": "min"}).first()[0] > 0


def test_every_query_has_builder_and_named_columns():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_sample_queries_run_on_smoke_data(spark):
    qs = E.queries()
    for name in ("F9_regex_lines", "J6_version_diffs", "W1_latest_result", "J9_copy_groups", "X13_feature_rows"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0, name

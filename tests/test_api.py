from vellum import api

SF = "/root/testdata/sf0.001"


def test_entry_points_run(spark):
    c = api.Corpus.from_test_tables(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert api.match_regex(c, "[0-9]").count() == docs.where("text rlike '[0-9]'").count() > 0
    det = api.match_regex_detailed(c, "[0-9]+").collect()
    assert all(len(r.lines) > 0 for r in det)
    assert api.program_entries_by_ids(c, [1, 2, 2, 3]).count() == 3
    assert api.frontend_count_by_ids(c, [1, 2, 3]).agg({"n": "sum"}).first()[0] == 3
    assert api.version_difference(c, "symbolic", "1-URGENT", "2-HIGH").count() == 1
    # the first 86,400 documents by id arrived on that day
    found = api.program_entries_by_metadata(c, 1704067200000, 1704153600000, 1, 100).collect()
    assert found and all(1 <= r.loc <= 100 for r in found)
    assert api.feature_values_by_program_id(c, 10).count() > 0
    js = api.as_json(api.program_entries_by_ids(c, [1]).select("entity_id", "loc")).first().json
    assert js.startswith('{"entity_id":1')

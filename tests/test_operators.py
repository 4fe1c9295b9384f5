from pyspark.sql import functions as F

from vellum.operators import features as X
from vellum.operators import maintenance as M
from vellum.operators import sequences as Q
from vellum.operators import versions as V


def results(spark, rows):
    return spark.createDataFrame(
        rows,
        "result_id long, version_hash string, entity_id long, success boolean, runtime long, "
        "errors array<struct<error_id:string,message:string>>",
    )


def test_version_summary_truncated_mean_and_variance(spark):
    r = results(spark, [(1, "v1", 7, True, 1, []), (2, "v1", 8, True, 2, []),
                        (3, "v2", 7, True, 1, []), (4, "v2", 8, True, 2, [])])
    s = V.version_diff_summary(r, "v1", "v2").first()
    assert (s.avg_runtime1, s.var_runtime1, s.n_shared) == (1, 0, 2)
    assert (s.n_success_diff, s.n_runtime_diff, s.n_error_diff) == (0, 0, 0)


def test_multiset_intersection(spark):
    r = results(spark, [(1, "v1", 1, True, 1, []), (2, "v1", 1, True, 1, []), (3, "v1", 2, True, 1, []),
                        (4, "v2", 1, True, 1, []), (5, "v2", 2, True, 1, []), (6, "v2", 2, True, 1, [])])
    assert sorted(x.entity_id for x in V.shared_entities(r, "v1", "v2").collect()) == [1, 2]


def test_version_diffs_exists_semantics(spark):
    e = [("a", "")]
    r = results(spark, [(1, "v1", 1, True, 100, e), (2, "v2", 1, False, 100, e), (3, "v2", 1, True, 400, [])])
    kinds = sorted((x.kind, x.result_id) for x in V.version_diffs(r, "v1", "v2", 1.5).collect())
    assert kinds == [("errors", 1), ("runtime", 1), ("success", 1)]


def test_insert_if_absent_first_value_kept(spark):
    existing = spark.createDataFrame([("f", 1, "x")], "name string, ref long, value string")
    new = spark.createDataFrame([("f", 1, "y", 0), ("g", 1, "first", 0), ("g", 1, "second", 1)],
                                "name string, ref long, value string, seq int")
    out = {(r.name, r.ref): r.value for r in X.insert_if_absent(existing, new, ["name", "ref"], "seq").collect()}
    assert out == {("f", 1): "x", ("g", 1): "first"}


def test_syntax_flags(spark):
    prog = "field f: Set[Int]\nmethod m() requires acc(x.f, wildcard)\n{ assert perm(x.f) > none\n  decreases }\n" \
           "predicate p() { forperm x: Ref [x.f] :: false }\npackage a --* b"
    df = spark.createDataFrame([(1, prog), (2, "var x: Int")], "entity_id long, program string")
    rows = {r.entity_id: r for r in df.select("entity_id", *X.syntax_flags(F.col("program"))).collect()}
    assert rows[1].hasSet and rows[1].hasWildcardPerm and rows[1].hasPerm and rows[1].hasTermination
    assert rows[1].hasForPerm and rows[1].hasMagicWand and not rows[1].hasSeq
    assert not any(rows[2][n] for n, _ in X.SYNTAX_FEATURES)


def _tree(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id long, section string, node_id long, parent_id long, depth int, kind string, name string"
    )


def test_tree_features(spark):
    rows = [
        (1, "predicate", 1, None, 0, "root", None),
        (1, "predicate", 2, 1, 1, "predicate", "p"),
        (1, "predicate", 3, 2, 2, "quantifier", None),
        (1, "predicate", 4, 3, 3, "acc", None),
        (1, "predicate", 5, 3, 3, "call", "p"),
        (2, "function", 1, None, 0, "root", None),
        (2, "function", 2, 1, 1, "function", "f"),
        (2, "function", 3, 2, 2, "quantifier", None),
        (2, "function", 4, 3, 3, "trigger", None),
        (2, "function", 5, 2, 2, "call", "g"),
    ]
    t = _tree(spark, rows)
    get = lambda df: {r.doc_id: r.value for r in df.collect()}
    assert get(X.has_recursive_decl(t, "predicate")) == {1: True, 2: False}
    assert get(X.has_recursive_decl(t, "function")) == {1: False, 2: False}
    assert get(X.has_missing_trigger(t)) == {1: True, 2: False}
    assert get(X.might_have_qp(t)) == {1: True, 2: False}
    assert get(X.find_node(t, F.col("kind") == "trigger")) == {1: False, 2: True}


def test_gap_to_previous_hot_key(spark):
    # one key holds most rows and spans several range partitions
    rows = [(0 if i % 10 else 1 + i % 3, i, i * i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {(r.k, r.t): r.gap for r in Q.gap_to_previous(df, "k", ["t"], "v", n_parts=6).collect()}
    last = {}
    for k, t, v in sorted(rows):
        assert got[(k, t)] == (v - last[k] if k in last else 0)
        last[k] = v


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long")
    got = sorted((r.x, r.id) for r in Q.dense_ids(df, ["x"], start=5, n_parts=4).collect())
    assert got == [(x, x + 5) for x in range(101)]


def test_upsert_and_cascade(spark):
    existing = spark.createDataFrame([(10, 1, 5), (20, 2, 6)], "pid long, eid long, v long")
    updates = spark.createDataFrame([(2, 60), (3, 70)], "eid long, v long")
    out = sorted(tuple(r) for r in M.upsert(existing, updates, "eid", "pid").collect())
    assert out == [(10, 1, 5), (20, 2, 60), (21, 3, 70)]
    c = spark.createDataFrame([(1,), (2,)], "ck long")
    o = spark.createDataFrame([(10, 1), (11, 2)], "ok long, ock long")
    li = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "lok long, ln int")
    rem = M.cascade_delete({"c": c, "o": o, "l": li}, [("o", "ock", "c", "ck"), ("l", "lok", "o", "ok")],
                           "c", spark.createDataFrame([(2,)], "ck long"), "ck")
    assert rem["c"].count() == 1 and rem["o"].count() == 1 and rem["l"].count() == 1


def test_integrity_report(spark):
    p = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    c = spark.createDataFrame([(1,), (9,)], "pk long")
    rep = {r.check_name: r.n_violations for r in M.integrity_report(
        {"p": p, "c": c}, {"p": ["k"]}, [("c", "pk", "p", "k")]).collect()}
    assert rep["not_null:p.k"] == 1 and rep["primary_key:p"] == 1 and rep["foreign_key:c.pk->p.k"] == 1


def test_result_similarity_all_vs_latest(spark):
    from vellum.operators import programs as PG

    r = spark.createDataFrame(
        [(1, "2024-01-01", 10, True, []), (2, "2024-01-02", 10, False, []),
         (3, "2024-01-01", 20, True, []), (4, "2024-01-03", 20, True, [])],
        "result_id long, creation_date string, entity_id long, success boolean, "
        "errors array<struct<error_id:string,message:string>>",
    ).withColumn("creation_date", F.col("creation_date").cast("timestamp_ntz"))
    pairs = spark.createDataFrame([(10, 20)], "a_id long, b_id long")
    # all results: entity 10 has a successful result like 20's -> similar (reference behaviour)
    assert PG.pairs_with_similar_results(pairs, r).count() == 1
    # latest only: 10's latest failed, 20's latest succeeded -> not similar
    assert PG.pairs_with_similar_results(pairs, r, latest_only=True).count() == 0


def test_version_diffs_distinct_option(spark):
    r = results(spark, [(1, "v1", 1, True, 100, []), (2, "v1", 1, True, 100, []), (3, "v2", 1, False, 100, [])])
    assert V.version_diffs(r, "v1", "v2").where("kind = 'success'").count() == 2
    assert V.version_diffs(r, "v1", "v2", distinct=True).where("kind = 'success'").count() == 1

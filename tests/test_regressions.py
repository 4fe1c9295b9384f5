"""Inputs on which earlier versions gave wrong answers or failed."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import regex as R
from vellum.operators import fingerprint as FP
from vellum.operators import maintenance as M
from vellum.operators import programs as PG
from vellum.operators import sequences as Q
from vellum.operators import similarity as SIM
from vellum.operators import versions as V
from vellum.sources import files as FS
from vellum.streaming import admission as K

A = "One two three four five. Six seven eight nine ten.\nAlpha beta gamma delta epsilon. Zeta eta theta iota."
B = "Totally other words stand here now. And more of them come later on.\nNothing of this is in the first text."


def nodes(spark, rows):
    schema = "doc_id long, section string, node_id long, parent_id long, depth int, ord int, kind string, commutative boolean"
    return spark.createDataFrame([(1, "s", *r, False) for r in rows], schema)


def test_split_conjunctions_renumbers_all_children(spark):
    # pre: and(a, and(b, c)), z, and(), y  -- ids are not in order of places
    tree = [(1, None, 0, 0, "root"), (2, 1, 1, 0, "pre"), (9, 2, 2, 0, "and"), (8, 9, 3, 0, "a"), (7, 9, 3, 1, "and"), (6, 7, 4, 0, "b"),
            (5, 7, 4, 1, "c"), (4, 2, 2, 1, "z"), (3, 2, 2, 2, "and"), (10, 2, 2, 3, "y"), (11, 5, 5, 0, "leaf")]
    got = PG.split_conjunctions(nodes(spark, tree)).orderBy("parent_id", "ord").collect()
    assert [(r.kind, r.ord, r.depth) for r in got if r.parent_id == 2] == [("a", 0, 2), ("b", 1, 2), ("c", 2, 2), ("z", 3, 2), ("y", 4, 2)]
    assert [(r.parent_id, r.depth) for r in got if r.kind == "leaf"] == [(5, 3)]


def test_split_conjunctions_of_deep_nests_and_large_places(spark):
    tree = [(1, None, 0, 0, "root"), (2, 1, 1, 0, "pre"), (3, 2, 2, 5000, "x")]
    parent = 2
    for i in range(66):  # more layers than the round limit that once was
        tree.append((100 + i, parent, 2 + i, 4000 if parent == 2 else 1, "and"))
        tree.append((300 + i, 100 + i, 3 + i, 0, f"k{i}"))
        parent = 100 + i
    got = PG.split_conjunctions(nodes(spark, tree)).where("parent_id = 2").orderBy("ord").collect()
    assert [r.kind for r in got] == [f"k{i}" for i in range(66)] + ["x"] and [r.ord for r in got] == list(range(67))


def test_variance_of_many_results_is_truncated(spark):
    n = 4_000_001
    results = spark.range(n).select(
        F.col("id").alias("result_id"), (F.col("id") % 2).alias("entity_id"), F.lit("v1").alias("version_hash"), F.lit(True).alias("success"),
        F.when(F.col("id") == 0, 1001).otherwise(1000).cast("long").alias("runtime"),
        F.array().cast("array<struct<error_id:string,message:string>>").alias("errors"))
    other = results.limit(2).select("result_id", "entity_id", F.lit("v2").alias("version_hash"), "success", "runtime", "errors")
    r = V.version_diff_summary(results.unionByName(other), "v1", "v2").first()
    assert (r.avg_runtime1, r.var_runtime1) == (1000, 0)


def test_marks_inside_the_text(spark):
    texts = [("ab",), ("",), ("ab\nab ab",), ("",)]
    df = spark.createDataFrame(texts, "t string")
    got = [r.x for r in df.select(R.match_lines(F.col("t"), "ab").alias("x")).collect()]
    assert got == [[], [], [1, 2, 2], []]
    assert [r.x for r in df.select(R.match_lines(F.col("t"), ".").alias("x")).collect()] == [[1, 1, 1], [1], [1, 1, 1, 2, 2, 2, 2, 2], []]
    assert [r.x for r in df.select(R.match_lines(F.col("t"), "(?m)^").alias("x")).collect()] == [[1], [1], [1, 2], []]


def test_cascade_over_uneven_paths(spark):
    tab = lambda rows, cols: spark.createDataFrame(rows, cols)
    tables = {"root": tab([(1,), (2,)], "r long"), "a": tab([(1, 1), (2, 2)], "a long, r long"), "b": tab([(1, 1), (2, 2)], "b long, r long"),
              "e": tab([(1, 1), (2, 2)], "e long, b long"), "c": tab([(1, 1, None), (2, None, 1), (3, 2, 2)], "c long, a long, e long"),
              "d": tab([(1, 1), (2, 2), (3, 3)], "d long, c long")}
    fks = [("a", "r", "root", "r"), ("b", "r", "root", "r"), ("e", "b", "b", "b"), ("c", "a", "a", "a"), ("c", "e", "e", "e"), ("d", "c", "c", "c")]
    left = M.cascade_delete(tables, fks, "root", tab([(1,)], "r long"), "r")
    assert {n: sorted(r[0] for r in df.collect()) for n, df in left.items()} == {"root": [2], "a": [2], "b": [2], "e": [2], "c": [3], "d": [3]}


def test_cascade_through_circles(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "id long, boss long")
    notes = spark.createDataFrame([(1, 3), (2, 5)], "n long, id long")
    left = M.cascade_delete({"p": people, "n": notes}, [("p", "boss", "p", "id"), ("n", "id", "p", "id")], "p",
                            spark.createDataFrame([(1,)], "id long"), "id")
    assert sorted(r.id for r in left["p"].collect()) == [4, 5] and [r.n for r in left["n"].collect()] == [2]


def test_upsert_with_repeated_keys(spark):
    existing = spark.createDataFrame([(10, "a", 1), (20, "b", 2)], "id long, k string, v long")
    updates = spark.createDataFrame([("a", 5), ("a", 7), ("c", 1), ("c", 1)], "k string, v long")
    got = sorted((r.k, r.id, r.v) for r in M.upsert(existing, updates, "k", "id").collect())
    assert got == [("a", 10, 7), ("b", 20, 2), ("c", 21, 1)]


def test_malformed_bytes_in_program_files(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\xffb")
    (tmp_path / "y.txt").write_bytes("é�".encode())
    got = {r.path[-5:]: r.program for r in FS.read_program_files(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": "ab", "y.txt": "é�"}


def test_gaps_of_large_numbers_and_null_keys(spark):
    big = 2**53
    rows = [("k", 1, big), ("k", 2, big + 1), ("k", 3, big + 2), (None, 1, 10), (None, 2, 25)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    for parts in (1, 5):
        got = {(r.k, r.t): r.gap for r in Q.gap_to_previous(df, "k", ["t"], "v", n_parts=parts).collect()}
        assert got == {("k", 1): 0, ("k", 2): 1, ("k", 3): 1, (None, 1): 0, (None, 2): 15}


def test_node_ids_are_unique_whatever_the_size(spark):
    docs = spark.createDataFrame([(1, "w " * 100_003 + ". Next one here.\n\nlast line")], "doc_id long, text string")
    n = FP.document_nodes(docs)
    r = n.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("d")).first()
    assert r.n == r.d == 1 + 3 + 3 + 100_004 + 3 + 2


def test_control_characters_stay_in_the_tree(spark):
    docs = spark.createDataFrame([(1, "a\u0001b c d e."), (2, "ab c d e.")], "doc_id long, text string")
    hashes = {r.root_hash for r in FP.document_prints(docs).collect()}
    assert len(hashes) == 2 and all(len(h) == 32 for h in hashes)


def test_sections_keep_their_text(spark):
    e = spark.createDataFrame([(1, "method a\u0002b\nfield f"), (2, "x\nmethod m")], "entity_id long, program string")
    got = [(r.entity_id, r.decl_index, r.section, r.decl_text) for r in PG.program_sections(e).orderBy("entity_id", "decl_index").collect()]
    assert got == [(1, 1, "method", "method a\u0002b\n"), (1, 2, "field", "field f"), (2, 0, "extension", "x\n"), (2, 1, "method", "method m")]


def items(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, loc int, direct boolean")
    return FP.document_prints(df, keep=["loc", "direct"])


def accepted(df):
    return {r.doc_id: r.accepted for r in df.collect()}


def test_long_chains_are_decided(spark):
    df = spark.createDataFrame([(i,) for i in range(16)], "doc_id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(15)], "e long, l long")
    assert accepted(K.greedy_admission(df, edges)) == {i: i % 2 == 0 for i in range(16)}


def test_copies_outside_the_band_are_accepted(spark):
    rows = [(1, A, 1, True), (2, A, 7, True), (3, A, 2, True)]
    assert accepted(K.admit(items(spark, rows), band=(0.5, 2.0))) == {1: True, 2: True, 3: False}
    assert accepted(K.admit(items(spark, rows))) == {1: True, 2: False, 3: False}


def test_copies_whose_results_differ_are_accepted(spark):
    err = "array<struct<error_id:string,message:string>>"
    res = lambda rows: spark.createDataFrame(rows, "entity_id long, success boolean").withColumn("errors", F.array().cast(err))
    r1 = res([(1, True), (2, False), (3, True), (4, True), (5, True), (5, False)])
    r2 = res([(1, True), (2, True), (3, True), (5, True)])
    rows = [(i, A, 2, True) for i in (1, 2, 3, 4, 5)]
    got = accepted(K.admit(items(spark, rows), extra=PG.result_filter(r1, r2)))
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}  # 4 has no result in the second back end


def test_empty_trees_are_similar_to_nothing(spark):
    rows = [(1, "ok", 1, True), (2, "ok", 1, True), (3, B, 2, True), (4, B, 2, True)]
    p = items(spark, rows)
    assert accepted(K.admit(p)) == {1: True, 2: True, 3: True, 4: False}
    assert accepted(K.admit(p, chunk_rows=1)) == {1: True, 2: True, 3: True, 4: False}
    assert {r.doc_id for r in SIM.duplicate_members(p).collect()} == {3, 4}


def test_generated_programs_are_judged_by_methods(spark):
    # 80 % of the nodes agree: enough for an item straight from a verifier, not for a generated one without methods
    lines = [f"Word{i} one two three four five six. Another{i} one two three four five." for i in range(10)]
    near = "\n".join(lines[:8] + ["Quite different words are here now. And there as well today.", "More of such words follow here. They differ from all else."])
    for direct, want in ((True, False), (False, True)):
        got = accepted(K.admit(items(spark, [(1, "\n".join(lines), 10, True), (2, near, 10, direct)]), direct="direct"))
        assert got == {1: True, 2: want}


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from vellum.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_failed_batches_leave_a_status_row(spark, tmp_path):
    bad = spark.createDataFrame([(1, "x")], "submission_id long, other string")
    with pytest.raises(Exception):  # noqa: B017
        K.process_batch(spark, bad, 3, str(tmp_path))
    r = spark.read.parquet(str(tmp_path / "status")).first()
    assert r.stage == "failed" and r.error and r.batch_id == 3


def test_events_as_a_folder_of_part_files(spark, tmp_path):
    from vellum.plans import REGISTRY

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert REGISTRY["K1_stream_accept"].build(spark, str(tmp_path)).count() == ev.count()

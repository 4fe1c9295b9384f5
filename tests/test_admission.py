import random

from pyspark.sql import functions as F

from vellum.streaming import admission as K


def test_greedy_equals_sequential_loop(spark):
    rng = random.Random(7)
    for trial in range(3):
        n = 30
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12}
        items = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
        e = spark.createDataFrame(sorted(edges) or [(0, 0)], "e long, l long").where("e < l")
        got = {r.doc_id: r.accepted for r in K.greedy_admission(items, e).collect()}
        assert got == K.sequential_admission_reference(list(range(n)), edges)


def _greedy(spark, n, edges, monkeypatch=None):
    calls = []
    if monkeypatch:
        real = K._admission_round
        monkeypatch.setattr(K, "_admission_round", lambda *a: calls.append(1) or real(*a))
    items = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
    e = spark.createDataFrame(sorted(edges), "e long, l long")
    return {r.doc_id: r.accepted for r in K.greedy_admission(items, e).collect()}, len(calls)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    edges = {(i, i + 1) for i in range(5000)} | {(5001, 5003), (5002, 5003)}
    got, rounds = _greedy(spark, 5004, edges, monkeypatch)
    assert got == K.sequential_admission_reference(list(range(5004)), edges)
    assert rounds <= 30


def test_chains_that_meet_part_and_cross(spark, monkeypatch):
    """Ladders, chains with rungs between them and both literals of an item at one node."""
    rng = random.Random(9)
    edges = {(i, i + 2) for i in range(300)} | {(i, i + 1) for i in range(0, 300, 7)} | {(i, i + 9) for i in range(0, 280, 13)}
    edges |= {(400, 401), (401, 402), (400, 403), (402, 403), (401, 404), (402, 404)}
    edges |= {tuple(sorted(rng.sample(range(500, 560), 2))) for _ in range(70)}
    got, rounds = _greedy(spark, 560, edges, monkeypatch)
    assert got == K.sequential_admission_reference(list(range(560)), edges)
    assert rounds <= 30


def test_null_and_negative_ids_of_a_stream(spark, tmp_path):
    from vellum.plans.catalog_tables import write_submissions

    a = "One two three four five. Six seven eight nine ten.\nAlpha beta gamma delta epsilon. Zeta eta theta iota."
    rows = [(None, a, "g", "s"), (-5, a, "g", "s"), (3, a, "g", "s"), (4, "Totally other words in here now. And more of them.", "g", "s")]
    docs = spark.createDataFrame(rows, "submission_id long, program string, frontend string, original_verifier string")
    write_submissions(docs, str(tmp_path / "subs"), file_rows=1)
    assert spark.read.parquet(str(tmp_path / "subs")).count() == 4
    K.start_admission_stream(spark, str(tmp_path / "subs"), str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files_per_trigger=1).awaitTermination()
    dec = {r.doc_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()}
    assert dec == {-5: True, 3: False, 4: True}
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1


def test_copies_of_another_size_are_no_copies_for_the_band(spark):
    """Documents 1 and 2 have one print and 2 and 7 lines; document 3 is like both, in the band of 2 alone."""
    from vellum.operators import similarity as SIM
    from vellum.operators.fingerprint import document_prints

    s = [f"w{i}a w{i}b w{i}c w{i}d w{i}e." for i in range(12)]
    text = "\n".join(s)
    rows = [(1, text, 2), (2, text, 7), (3, "\n".join(s[:11]), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loc int")
    pairs, groups = SIM.similar_groups(document_prints(docs, keep=["loc"]), [], (0.5, 2.0))
    assert {(r.a_id, r.b_id) for r in pairs.collect()} == {(2, 3)}
    assert {(r.doc_id, r.rep_id) for r in groups.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_stored_items_reject_later_similar(spark):
    items = spark.createDataFrame([(10,), (11,)], "doc_id long")
    stored = spark.createDataFrame([(1,)], "doc_id long")
    edges = spark.createDataFrame([(1, 10)], "e long, l long")
    got = {r.doc_id: r.accepted for r in K.greedy_admission(items, edges, stored).collect()}
    assert got == {10: False, 11: True}


def test_admit_documents_copies_rejected(spark):
    from vellum.operators.fingerprint import document_prints

    a = "One two three four five. Six seven eight nine ten.\nAlpha beta gamma delta epsilon. Zeta eta theta iota."
    docs = spark.createDataFrame([(1, a), (2, a), (3, "Totally other words in here now. And more of them.")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.accepted for r in K.admit(document_prints(docs)).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_evaluator_captures_errors(spark):
    df = spark.createDataFrame([(1, "x", 3, []), (2, "y", 1, [])], "entity_id long, program string, loc int, args array<string>")

    def ev(entity, args, timeout):
        if entity["entity_id"] == 2:
            raise RuntimeError("boom")
        return {"success": True, "runtime": 5}

    rows = {r.entity_id: r for r in K.evaluate(df, ev, "symbolic").collect()}
    assert rows[1].success and rows[1].runtime == 5
    assert not rows[2].success and rows[2].error_ids == ["evaluator:RuntimeError"]


def test_stream_admission_runs(spark, tmp_path):
    subs = str(tmp_path / "subs")
    a = "One two three four five. Six seven eight nine ten.\nAlpha beta gamma delta epsilon. Zeta eta theta iota."
    spark.createDataFrame([(1, a, "g", "s"), (2, a, "g", "s"), (3, None, "g", "s")],
                          "submission_id long, program string, frontend string, original_verifier string") \
        .coalesce(1).write.parquet(subs)
    q = K.start_admission_stream(spark, subs, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    dec = {r.doc_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()}
    assert dec == {1: True, 2: False}
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1


def test_admission_equals_loop_over_brute_force_edges(spark):
    """K3 on real documents = one-by-one loop over all-pairs decisions (copies included as 100 % pairs)."""
    import itertools

    from vellum.operators import similarity as SIM
    from vellum.plans.catalog_similarity import BAND, entity_prints

    keys = ["frontend", "original_verifier", "parse_success"]
    ep = entity_prints(spark, "/root/testdata/sf0.001")
    got = {r.doc_id: r.accepted for r in K.admit(ep, None, block=keys, band=BAND).collect()}
    ps = SIM.prepare(ep)
    meta = {r.doc_id: r for r in ps.docs.collect()}
    ids = sorted(meta)
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2)
             if all(meta[a][k] == meta[b][k] for k in keys)
             and int(BAND[0] * meta[b].loc) <= meta[a].loc <= int(BAND[1] * meta[b].loc)]
    pdf = spark.createDataFrame(pairs, "a_id long, b_id long")
    scored = SIM.with_decision(SIM.matched_weight(pdf, ps)).where("is_match").collect()
    edges = {(r.a_id, r.b_id) for r in scored}
    assert got == K.sequential_admission_reference(ids, edges)
    assert sum(not v for v in got.values()) > 0  # some items are rejected on this data


def test_stream_two_batches_probe_corpus(spark, tmp_path):
    subs = str(tmp_path / "subs")
    a = "One two three four five. Six seven eight nine ten.\nAlpha beta gamma delta epsilon. Zeta eta theta iota."
    b = a + "\nKappa lambda mu nu xi. Omicron pi rho sigma tau."  # contains a: subset match
    c = "Totally other words in here now. And more of them to see."
    spark.createDataFrame([(1, a, "g", "s")], "submission_id long, program string, frontend string, original_verifier string") \
        .coalesce(1).write.mode("append").parquet(subs)
    spark.createDataFrame([(2, b, "g", "s"), (3, c, "g", "s"), (4, a.upper(), "g", "s")],
                          "submission_id long, program string, frontend string, original_verifier string") \
        .coalesce(1).write.mode("append").parquet(subs)
    q = K.start_admission_stream(spark, subs, str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    dec = {r.doc_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()}
    assert dec == {1: True, 2: False, 3: True, 4: False}
    status = spark.read.parquet(str(tmp_path / "out" / "status")).count()
    assert status == 2


def test_chunked_admission_equals_unchunked(spark):
    from vellum.plans.catalog_similarity import BAND, entity_prints

    keys = ["frontend", "original_verifier", "parse_success"]
    ep = entity_prints(spark, "/root/testdata/sf0.001")
    whole = {r.doc_id: r.accepted for r in K.admit(ep, None, block=keys, band=BAND).collect()}
    chunked = {r.doc_id: r.accepted for r in K.admit(ep, None, block=keys, band=BAND, chunk_rows=60).collect()}
    assert chunked == whole
    plain = {r.doc_id: r.accepted for r in K.admit(ep, None, chunk_rows=45).collect()}
    assert plain == {r.doc_id: r.accepted for r in K.admit(ep, None).collect()}


def test_accept_stream_is_exactly_once(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    out, ck = str(tmp_path / "queue"), str(tmp_path / "ckpt")
    K.start_accept_stream(spark, src, out, ck, glob="events.parquet").awaitTermination()
    n1 = spark.read.parquet(out).count()
    # a restart with the same checkpoint finds nothing new: no duplicates
    K.start_accept_stream(spark, src, out, ck, glob="events.parquet").awaitTermination()
    n2 = spark.read.parquet(out).count()
    assert n1 == n2 == spark.read.parquet(f"{src}/events.parquet").count()

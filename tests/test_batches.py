"""Batches that commit whole (S7), text containers (S15) and the evaluator's time limit (U-1)."""

import os
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import maintenance as M
from vellum.sources import files as FS
from vellum.streaming import admission as K


def _insert(spark, root, commit, keys):
    e = spark.createDataFrame([(k, f"e{k}") for k in keys], "k long, name string")
    p = spark.createDataFrame([(k, k * 10) for k in keys], "k long, print long")
    r = spark.createDataFrame([(k, True, {"f": str(k), "g": "x"}) for k in keys], "k long, success boolean, features map<string,string>")
    return M.insert_batch(spark, root, commit, e, p, {"a": r, "b": r.where("k % 2 = 0")}, "k")


def _state(spark, root):
    def rows(t):
        df = M.read_committed(spark, root, t)
        return None if df is None else sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    return {t: rows(t) for t in M.BATCH_TABLES}


def test_keys_go_down_three_levels(spark, tmp_path):
    root = str(tmp_path)
    assert _insert(spark, root, 1, [30, 10, 20]) and _insert(spark, root, 2, [7, 8])
    ent = {r.k: r.entity_id for r in M.read_committed(spark, root, "entities").collect()}
    assert ent == {10: 1, 20: 2, 30: 3, 7: 4, 8: 5}
    res = {r.entity_id: r.result_id for r in M.read_committed(spark, root, "results_b").collect()}
    assert res == {1: 1, 2: 2, 3: 3, 5: 4}
    feats = {(r.ref_kind, r.ref_id, r.feature_name): r.value for r in M.read_committed(spark, root, "features").collect()}
    assert feats["b", 4, "f"] == "8" and feats["a", 4, "f"] == "7" and len(feats) == 2 * (5 + 4)
    assert {r.entity_id: r.print for r in M.read_committed(spark, root, "prints").collect()} == {ent[k]: k * 10 for k in ent}


@pytest.mark.parametrize("after", range(6))
def test_a_kill_between_two_writes_leaves_the_old_version(spark, tmp_path, monkeypatch, after):
    root = str(tmp_path)
    _insert(spark, root, 1, [1, 2])
    before, real, count = _state(spark, root), M._write_part, []

    def failing(df, path):
        if len(count) == after:
            raise RuntimeError("killed")
        count.append(path)
        real(df, path)

    monkeypatch.setattr(M, "_write_part", failing)
    with pytest.raises(RuntimeError):
        _insert(spark, root, 2, [3, 4])
    assert _state(spark, root) == before
    monkeypatch.setattr(M, "_write_part", real)
    assert _insert(spark, root, 2, [3, 4])  # made again over what was left
    whole = _state(spark, root)
    assert len(whole["entities"]) == 4 and len(whole["features"]) == 12
    assert not _insert(spark, root, 2, [3, 4]) and _state(spark, root) == whole  # replay changes nothing


def test_text_containers(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text\r\n\n"), F.col("id").cast("string"), F.lit("ü\n")).alias("text"))
    FS.write_text_container(df, path, "doc_id", "text")
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1 and not [d for d in os.listdir(path) if os.path.isdir(os.path.join(path, d))]
    back = FS.read_text_container(spark, path)
    assert df.join(back, (F.col("doc_id") == F.col("id")) & (F.col("text") == F.col("program"))).count() == 100_000
    some = FS.read_text_container(spark, path, ids=[5, 99_999, 200_000])
    assert {r.id: r.program for r in some.collect()} == {k: f"text\r\n\n{k}ü\n" for k in (5, 99_999)}
    assert "PushedFilters: [In(id" in some._jdf.queryExecution().toString()
    FS.write_text_container(df, path, "doc_id", "text", container_bytes=300_000)
    assert 1 < len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 6
    FS.write_text_container(df.limit(0), path, "doc_id", "text")
    assert FS.read_text_container(spark, path).count() == 0


def test_an_evaluator_that_never_ends(spark):
    df = spark.createDataFrame([(k, f"p{k}", [], 1 if k % 4 == 1 else 30) for k in range(12)], "entity_id long, program string, args array<string>, timeout_seconds int").coalesce(2)

    def ev(entity, args, timeout):
        if entity["entity_id"] % 4 == 1:
            while True:
                time.sleep(60)
        if entity["entity_id"] == 6:
            os._exit(3)
        if entity["entity_id"] == 7:
            raise ValueError("x")
        return {"success": True, "runtime": timeout, "features": {"id": entity["entity_id"]}}

    start = time.time()
    got = {r.entity_id: r for r in K.evaluate(df, ev, "symbolic").collect()}
    assert time.time() - start < 60 and len(got) == 12
    for k, r in got.items():
        if k % 4 == 1:
            assert (r.success, r.did_timeout, r.runtime, r.error_ids) == (False, True, 1000, ["evaluator:timeout"])
        elif k == 6:
            assert r.error_ids == ["evaluator:ended"] and not r.did_timeout
        elif k == 7:
            assert r.error_ids == ["evaluator:ValueError"]
        else:
            assert r.success and r.runtime == 30 and r.features == {"id": str(k)}

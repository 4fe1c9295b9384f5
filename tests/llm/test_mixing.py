import re
from collections import Counter, defaultdict

from llm_fixtures import odd_rows, prose, table
from pyspark.sql import functions as F

from vellum.llm import mixing
from vellum.llm.queries import QUERIES


def slow_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(rows):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += slow_size(t)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:  # deal by weight; what stands above its limit is fixed there and the rest is dealt again
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            return size, {**target, **{s: level * weight[s] for s in free}}
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)


def check(spark, rows, slack):
    docs = table(spark, rows)
    got = mixing.plan(docs).collect()
    size, target = slow_targets(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, slow_size(t)) for d, t, _, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack(s), (s, taken[s], t)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want, out = Counter(), Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    for r in mixed.collect():
        out[r.doc_id, r.source, slow_size(r.text)] += 1
    assert out == +want
    again = mixing.plan(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_targets_and_taken_words(spark):
    import random
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 300)), "en", rng.choice(["a", "b", "c", "dé", "Z", None, "hot", "hot", "hot"])) for i in range(500)]
    rows += [(9000, "tiny", "en", "zz"), (9001, None, "en", "none"), (9002, "x y", "en", "zzz")]
    check(spark, rows, lambda s: 150 if s not in ("zz", "zzz") else 2)  # half of the longest document, plus rounding


def test_repeated_rows_meet_their_target(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", "a")] * 300 + [(i, f"{words} {i}", "en", "b") for i in range(2, 300)]
    check(spark, rows, lambda s: 31)


def test_many_equal_rows_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    rows = [(1, "a b c", "en", "a")] * 200 + [(2, "a b c", "en", "a")] * 7 + [(3, "a b c", "en", "b")] * 8 + [(4, "x", "en", "c")] * 100
    check(spark, rows, lambda s: 3)


def test_odd_documents(spark):
    rows = odd_rows()
    check(spark, rows, lambda s: 30_000)


def test_pareto_sample_is_unequal_and_fixed_in_size(spark):
    rows = [(i, "w " * (5 if i % 2 else 500), "en", "ab"[i % 4 // 2]) for i in range(2000)]
    got = mixing.plan(table(spark, rows)).groupBy("source", "size").agg(F.avg("copies").alias("c")).collect()
    c = {(r.source, r.size): r.c for r in got}
    assert c["a", 500] > c["a", 5] and c["b", 500] > c["b", 5]  # longer documents have the greater inclusion measure


def test_empty_table_and_one_source(spark):
    assert mixing.plan(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [])).count() == 0
    got = mixing.plan(table(spark, [(1, "a b", None, None), (2, "", None, None)])).collect()
    assert {(r.doc_id, r.copies, r.target) for r in got} == {(1, 1, 2.0), (2, 0, 2.0)}


def test_query(spark):
    got = QUERIES["op9_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    assert abs(got["taken"].sum() / got["size"].sum() - 1) < 0.02 and (got["taken"] <= 3 * got["size"]).all()

import random
import re
from collections import defaultdict

import pytest
import xxhash
from llm_fixtures import odd_rows, prose, table
from pyspark.sql import functions as F

from vellum.llm import simhash
from vellum.llm.components import components
from vellum.llm.queries import QUERIES


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(pairs):
    """pairs (doc_id, fingerprint) -> least doc_id reachable for each."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in pairs:
        least[find(f)].append(d)
    return [min((x for x in least[find(f)] if x is not None), default=None) for _, f in pairs]


def test_odd_documents_against_brute_force(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(table(spark, rows)).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, slow_components(prints), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_every_pair_within_two_bits_is_linked_and_no_other(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):  # dense clusters: one and two bits from a centre, bit 63 among them
        c = rng.getrandbits(64)
        fps |= {c, c ^ 1 << 63, c ^ 1 << 63 ^ 1} | {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    fps |= {0, 1, 3, 7, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(df).collect()}
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert got == want
    most = simhash.anchors(df).groupBy("fp").count().agg(F.max("count")).first()[0]
    assert most == 32  # replicas of a fingerprint


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 400)] + [(500, 500), (600, 599), (599, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 400)}, 599: 599, 600: 599}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_row_of_each_component(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    comps = slow_components(prints)
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(set(comps))
    assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}


def test_dedup_of_rows_without_ids_and_of_empty_tables(spark):
    rng = random.Random(3)
    t = prose(rng, 30)
    assert simhash.dedup(table(spark, [(None, t, "en", "a")] * 3)).count() == 1
    assert simhash.dedup(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_larger_thresholds_are_refused(spark):
    with pytest.raises(ValueError, match="2 bits"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_query_on_small_table(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op1_simhash"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    assert {tuple(r) for r in got} == {(d, f"{f:016x}", c) for (d, f), c in zip(prints, slow_components(prints), strict=True)}

import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm_fixtures import odd_rows, prose, table
from pyspark.sql import functions as F

from vellum.llm import divergence

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, min_docs=30, top=50):
    terms = lambda t: [x.translate(UP) for x in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = terms(text)
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            mass = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // mass for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top}
    return out


def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "fr"]), rng.choice(["hot"] * 5 + ["a", "b", "c", "ä", "Z", None])) for i in range(400)]
    out += [(500 + i, "Größe GRÖSSE ſtraße ÄÖ äö K 中文 " * 3, "de", f"s{i % 7}") for i in range(40)]
    out += [(600, "only one", "xx", "a"), (601, None, "xx", "b"), (602, "", "xx", "c"), (603, "1 2 3", "yy", "a")]
    return out + odd_rows()


def collected(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_against_brute_force(spark):
    got = collected(divergence.audit(table(spark, rows())))
    assert len(got) == len(set(got)) and set(got) == slow(rows())


def test_small_blocks_and_tiles_give_the_same(spark):
    got = collected(divergence.audit(table(spark, rows()), min_docs=3, top=4, block=5, tile=2))
    assert len(got) == len(set(got)) and set(got) == slow(rows(), min_docs=3, top=4)


def test_tasks_that_hand_their_counts_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 7)
    got = divergence.group_counts(table(spark, rows()[:50])).collect()
    monkeypatch.undo()
    want = divergence.group_counts(table(spark, rows()[:50])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_runs_against_whole_columns():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 3, 60), rng.integers(0, 3, 60)

        def runs(x):
            last = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)
            return x[last], last + 1

        assert divergence.compare(runs(a), runs(b)) == int(np.abs(a - b).sum())


def test_shares_of_counts_beyond_64_bit_products(spark):
    big = 4 * 10 ** 18
    want = 1 + 1_000_000_000 * (big + 5) // (big + 12345)
    assert divergence.shares(np.array([big, 7, big]), big + 12345).tolist() == [want, 1, want]
    df = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 12345)).alias("p"))
    assert df.first().p == want


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []

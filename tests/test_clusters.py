"""Near-duplicate clusters: exact, without the pairs inside a cluster."""

import random

from vellum.operators import similarity as SIM
from vellum.operators.components import components
from vellum.operators.fingerprint import document_prints


def test_components_against_a_plain_walk(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200, 200 + i) for i in range(1, 40)] + [(5, 5)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if near[n] != {n}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def sentence(rng):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) + "."


def test_edits_of_one_text_and_chains(spark, monkeypatch):
    """400 edits of one text are one cluster of 400 rows from few pairs; a chain whose ends are unlike is one cluster too."""
    rng = random.Random(5)
    base = [sentence(rng) for _ in range(20)]
    rows = []
    for i in range(400):
        lines = list(base)
        lines[rng.randrange(20)] = sentence(rng)
        rows.append((i, "\n".join(lines)))
    chain = [sentence(rng) for _ in range(60)]
    rows += [(1000 + k, "\n".join(chain[4 * k:4 * k + 20])) for k in range(10)]  # each like its neighbours alone
    rows += [(2000 + k, "\n".join(sentence(rng) for _ in range(20))) for k in range(20)] + [(3000, ""), (3001, ""), (3002, rows[-1][1])]
    seen = []
    real = SIM.matched_weight
    monkeypatch.setattr(SIM, "matched_weight", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.cluster_id, r.n_docs) for r in SIM.near_duplicate_clusters(document_prints(docs)).collect()}
    want = {(i, 0, 400) for i in range(400)} | {(k, 1000, 11) for k in (*range(1000, 1010), 3002)}  # 3002 is a copy of 1009
    assert got == want
    assert sum(seen) < 4 * len(rows)  # of 79,800 pairs

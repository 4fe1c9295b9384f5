import hashlib
import random
from collections import Counter, defaultdict

from llm_fixtures import odd_rows, prose, table
from pyspark.sql import functions as F

from vellum.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def slow(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    docs = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                docs[key(x)].add(d)
    last = {k: max(s) for k, s in docs.items() if len(s) >= min_docs}
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or last.get(key(x), d) == d]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def rows():
    rng = random.Random(7)
    common = [f"This LINE number {i} stands in many documents of the corpus" for i in range(6)] + ["Ünïcode LINE ÄÖ that stands in many documents, ſ K"]
    out = [(i, "\n".join(rng.choice([rng.choice(common), "\t " + rng.choice(common).upper() + " \r", prose(rng, 9), "", "short"]) for _ in range(rng.randrange(1, 9))), "en", "a")
           for i in range(120)]
    out += [(200 + i, "x" * 39 + "\n" + "y" * 40 + "\n\n", "en", "hot") for i in range(30)]
    out += [(300, "\n".join(common * 200), "en", "a"), (None, common[0], "en", "a"), (400, common[0], "en", "a"), (400, common[0], "en", "a"), (400, common[1], "en", "a")]
    out += [(500 + i, "A line that exactly four documents hold: one too few.", "en", "a") for i in range(4)] + [(503, "A line that exactly four documents hold: one too few.", "en", "a")]
    return out + odd_rows()


def test_against_brute_force(spark):
    got = line_dedup.line_report(table(spark, rows())).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == slow(rows())


def test_all_columns_stay_and_texts_are_cut(spark):
    docs = table(spark, rows())
    out = line_dedup.line_dedup(docs, min_docs=3)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({(d, t): 0 for d, _, _, t in ()}) + Counter(
        (d, t) for (d, _, _, t), n in slow(rows(), min_docs=3).items() for _ in range(n))


def test_empty_table_and_digest(spark):
    assert line_dedup.line_report(table(spark, [])).count() == 0
    r = line_dedup.line_report(table(spark, [(1, None, None, None)])).select("n_lines", "n_dropped", F.sha2("text", 256).alias("h")).first()
    assert tuple(r) == (1, 0, hashlib.sha256(b"").hexdigest())

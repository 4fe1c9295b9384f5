"""Property tests: Spark expressions against plain Python models of the same rules.

Each hypothesis example is a whole batch of inputs evaluated in one Spark job.
"""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.functions.regex import match_lines

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.lists(st.text(alphabet="ab(x)\n ", max_size=30), min_size=1, max_size=40)


def py_loc(t: str) -> int:
    # Java String.split("\n"): trailing empty strings removed, but "" -> [""]
    if t == "":
        return 1
    parts = t.split("\n")
    while parts and parts[-1] == "":
        parts.pop()
    return len(parts)


def py_match_lines(t: str, pat: str) -> list[int]:
    return [t.count("\n", 0, m.start()) + 1 for m in re.finditer(pat, t)]


@FAST
@given(texts)
def test_loc_matches_java_split(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    got = [r.x for r in df.select(S.loc("t").alias("x")).collect()]
    assert got == [py_loc(t) for t in batch]


@FAST
@given(texts, st.sampled_from([r"a+", r"\([^)]*\)", r"x", r"b\s*a", r"(?m)^a"]))
def test_match_lines_matches_find_loop(spark, batch, pat):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    got = [r.x for r in df.select(match_lines(F.col("t"), pat).alias("x")).collect()]
    assert got == [py_match_lines(t, pat) for t in batch]


def py_filter_args(args: list[str], flag: str) -> list[str]:
    if flag not in args:
        return args
    i = args.index(flag)
    if i < len(args) - 1 and args[i + 1].startswith("--"):
        return args[:i] + args[i + 1:]
    return args[:i] + args[i + 2:]


arg_lists = st.lists(st.lists(st.sampled_from(["--timeout", "--z3Exe", "--cvc5Exe", "5", "x", "--other", "--tempDirectory"]),
                              max_size=8), min_size=1, max_size=20)


@FAST
@given(arg_lists)
def test_strip_options_matches_fold(spark, batch):
    df = spark.createDataFrame([(a,) for a in batch], "a array<string>")
    got = [r.x for r in df.select(S.strip_options("a").alias("x")).collect()]
    want = []
    for a in batch:
        for f in S.STRIP_FLAGS_SYMBOLIC:
            a = py_filter_args(a, f)
        want.append(a)
    assert got == want


@FAST
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=40))
def test_greedy_admission_matches_loop(spark, raw_edges):
    from vellum.streaming import admission as K

    edges = {(min(a, b), max(a, b)) for a, b in raw_edges if a != b}
    items = spark.createDataFrame([(i,) for i in range(15)], "doc_id long")
    e = spark.createDataFrame(sorted(edges) or [(0, 0)], "e long, l long").where("e < l")
    got = {r.doc_id: r.accepted for r in K.greedy_admission(items, e).collect()}
    assert got == K.sequential_admission_reference(list(range(15)), edges)


def test_null_and_empty_inputs(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    rows = df.select(S.loc("t").alias("l"), match_lines(F.col("t"), "a").alias("m")).collect()
    assert rows[0].l is None and rows[1].l == 1 and rows[1].m == []


def test_version_summary_empty_sides(spark):
    from vellum.operators import versions as V

    r = spark.createDataFrame([(1, "v1", 1, True, 5, [])],
                              "result_id long, version_hash string, entity_id long, success boolean, runtime long, "
                              "errors array<struct<error_id:string,message:string>>")
    s = V.version_diff_summary(r, "v1", "v2").first()
    assert (s.n_shared, s.avg_runtime1, s.avg_runtime2, s.var_runtime1, s.var_runtime2) == (0, 0, 0, 0, 0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["A b c d.", "E f g h.", "I j k l.", "M n o p q.", "R s t u."]),
                         min_size=1, max_size=6), min_size=4, max_size=12))
def test_candidates_cover_brute_force(spark, docs):
    """Every pair the brute-force matcher accepts is among the prefix-filter candidates."""
    import itertools

    from vellum.operators import fingerprint as FP
    from vellum.operators import similarity as SIM

    rows = [(i, "\n".join(" ".join(d[j:j + 2]) for j in range(0, len(d), 2))) for i, d in enumerate(docs)]
    pr = FP.document_prints(spark.createDataFrame(rows, "doc_id long, text string"))
    ps = SIM.prepare(pr)
    cand = {(r.a_id, r.b_id) for r in SIM.candidate_pairs(ps).collect()}
    allp = spark.createDataFrame(list(itertools.combinations(range(len(docs)), 2)), "a_id long, b_id long")
    brute = SIM.with_decision(SIM.matched_weight(allp, ps)).where("is_match").collect()
    assert {(r.a_id, r.b_id) for r in brute} <= cand


def test_version_diffs_match_nested_loops_with_hot_entity(spark):
    import random

    from vellum.operators import versions as V

    rng = random.Random(11)
    rows = []
    for rid in range(300):
        ent = 0 if rid % 3 == 0 else rng.randint(1, 40)
        ver = rng.choice(["v1", "v2", "v3"])
        errs = [(e, "") for e in sorted(rng.sample(["a", "b", "c"], rng.randint(0, 2)))]
        rows.append((rid, ver, ent, rng.random() < 0.5, rng.randint(0, 400), errs))
    df = spark.createDataFrame(rows, "result_id long, version_hash string, entity_id long, success boolean, "
                                     "runtime long, errors array<struct<error_id:string,message:string>>")
    k = 1.5
    r1 = [r for r in rows if r[1] == "v1"]
    r2 = [r for r in rows if r[1] == "v2"]
    e1, e2 = [r[2] for r in r1], [r[2] for r in r2]
    shared = set(e1) & set(e2)
    a = [r for r in r1 if r[2] in shared]
    b = [r for r in r2 if r[2] in shared]
    errset = lambda r: sorted({e for e, _ in r[5]})
    want = sorted(
        [("success", x[2], x[0]) for x in a if any(y[2] == x[2] and y[3] != x[3] for y in b)]
        + [("runtime", x[2], x[0]) for x in a if any(y[2] == x[2] and (x[4] <= y[4] / k or x[4] >= y[4] * k) for y in b)]
        + [("errors", x[2], x[0]) for x in a if any(y[2] == x[2] and errset(y) != errset(x) for y in b)]
    )
    got = sorted((r.kind, r.entity_id, r.result_id) for r in V.version_diffs(df, "v1", "v2", k).collect())
    assert got == want
    s = V.version_diff_summary(df, "v1", "v2", k).first()
    mean = lambda xs: sum(xs) // len(xs) if xs else 0
    m1 = mean([x[4] for x in a])
    var1 = int(sum((x[4] - m1) ** 2 for x in a) / len(a)) if a else 0
    from collections import Counter

    c1, c2 = Counter(e1), Counter(e2)
    assert s.n_shared == sum((c1 & c2).values())
    assert (s.avg_runtime1, s.var_runtime1) == (m1, var1)

import base64
import hashlib
import math
import random
import re

import numpy as np
from llm_fixtures import odd_rows, prose, table

from vellum.llm import secret_scan
from vellum.llm.queries import QUERIES

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def slow_base(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


def slow_battery(s):
    for name, pattern, alphabet in secret_scan.ENCODINGS:
        if re.search(pattern, s):
            break
    sym = s.lower() if name in ("hex", "base36") else s.replace("-", "+").replace("_", "/").replace("=", "")
    v = np.array([alphabet.find(c) + 1 for c in sym], float)
    n, k = len(v), len(alphabet)
    chi2 = k / n * sum(sym.count(c) ** 2 for c in alphabet) - n
    up = v > k // 2
    runs, ones = 1 + np.count_nonzero(up[1:] != up[:-1]), np.count_nonzero(up)
    mean = 2 * ones * (n - ones) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = (runs - mean) / math.sqrt(var) if var > 0 else 99.0
    c = v - v.mean()
    z_serial = (c[1:] * c[:-1]).sum() / (c * c).sum() * math.sqrt(n) if (c * c).sum() > 0 else 99.0
    shift = n * secret_scan.UNEVEN[name]
    z = (chi2 - (k - 1) - shift) / math.sqrt(2 * (k - 1) + 4 * shift)
    p = 0.5 * math.erfc(-z / math.sqrt(2)) if max(abs(z_runs), abs(z_serial)) <= secret_scan.VETO else 1.0
    return name, n, chi2, z_runs, z_serial, p


def texts():
    rng = random.Random(3)
    key = lambda n, a="0123456789abcdef": "".join(rng.choices(a, k=n))
    out = [f'x token = "{key(40)}" y', f"PassWord: {key(8)} api_key='{key(5)}'", f"AKIA{key(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}", "AKIA123 AKIAAKIA",
           f"é中\U0001f600 {key(24)} {key(23)}", "token=token=secret=abcdef1 toKen : x token:  'abc", "password=token=\"abcdef\"", key(400), "a" * 30,
           f"{prose(rng, 20)} {base64.b64encode(rng.randbytes(48)).decode()} {prose(rng, 5)}", f"SECRET=..//{key(6)} ſecret=abcdefgh apiKey=123456",
           "http://example.org/a-very-long-slug-of-ordinary-words-that-is-no-secret/at_all_in_this_text", "ThisIsAnOrdinaryCamelCaseIdentifierOfSomeLength",
           "0" * 40 + " " + "01" * 30, "passwd" * 20, "-" * 60, f"token={key(30)}.{key(30)}\ntoken\n=abcdefg"]
    return out + [prose(rng, 80) for _ in range(30)]


def test_base_spans_against_python(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(texts())] + odd_rows()
    got = secret_scan.secret_spans(table(spark, rows)).collect()
    want = sorted((str(r[0]), slow_base(r[1])) for r in rows)
    have = sorted((str(r.doc_id), sorted((x.start, k, x.end, name) for k, name in enumerate(secret_scan.KINDS) for x in r[name])) for r in got)
    assert have == want


def test_battery_against_python(spark):
    rng = random.Random(5)
    strings = [m[0] for t in texts() for m in re.finditer(secret_scan.CANDIDATE, t)]
    strings += ["".join(rng.choices(a, k=n)) for _, _, a in secret_scan.ENCODINGS for n in (20, 33, 64, 300)]
    got = secret_scan.test_battery(spark.createDataFrame([(s,) for s in strings], "s string")).collect()
    want = {s: slow_battery(s) for s in strings if len(s.strip("=")) > 1}
    assert len({r.s for r in got}) == len(want)
    for r in got:
        name, n, *numbers = want[r.s]
        assert (r.encoding, r.n) == (name, n)
        assert np.allclose([r.chi2, r.z_runs, r.z_serial, r.p], numbers, atol=1e-6), (r, want[r.s])


def test_random_strings_are_found_and_ordinary_ones_are_not(spark):
    rng = random.Random(9)
    secrets = {i: base64.b64encode(rng.randbytes(36)).decode() for i in range(40)}
    rows = [(i, f"{prose(rng, 10)} {s} {prose(rng, 10)}", "en", "a") for i, s in secrets.items()]
    rows += [(100 + i, " ".join("-".join(prose(rng, 6, 9).split()) for _ in range(3)), "en", "a") for i in range(60)]
    got = {r.doc_id: r.random for r in secret_scan.secret_spans(table(spark, rows)).collect()}
    assert sum(len(got[i]) == 1 for i in secrets) >= 36
    assert sum(len(v) for d, v in got.items() if d >= 100) <= 1
    for i in secrets:
        for x in got[i]:
            assert rows[i][1][x.start:x.end] == secrets[i] and x.encoding == "base64"


def test_candidates_over_base_spans_are_left_out_and_empty_tables(spark):
    t = "token = " + hashlib.sha256(b"1").hexdigest()
    r = secret_scan.secret_spans(table(spark, [(1, t, "en", "a")])).first()
    assert len(r.assign) == len(r.hex) == 1 and r.random == []
    assert secret_scan.secret_spans(table(spark, [])).count() == 0


def test_query_digests(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_secrets"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        base = slow_base(text[r.doc_id])
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in secret_scan.KINDS)
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_very_many_matches_in_one_text_take_linear_time(spark):
    import time

    def seconds(n):
        text = " ".join(f"AKIA{i:018d}" for i in range(n))
        docs = table(spark, [(1, text, "en", "a")])
        start = time.time()
        r = secret_scan.scan(docs).select("access").first()
        assert [(x.start, x.end) for x in r.access] == [(23 * i, 23 * i + 22) for i in range(n)]
        return time.time() - start

    seconds(100)
    few, many = seconds(5_000), seconds(20_000)
    assert many < 8 * few + 3

import random
import textwrap

import numpy as np
from llm_fixtures import odd_rows, prose, table

from vellum.llm import license_scan
from vellum.llm.queries import QUERIES

LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Released under the MIT License.": "mit",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "This project is distributed under the GNU Lesser General Public License; see the file.": "lgpl",
}
ORDINARY = ["The driver was asked for a license and could not show one.", "Permission to speak was given to the member for the north.",
            "A general public meeting will be held.", "The software is free of bugs.", "Version 2.0 of the map is out."]


def test_licences_are_found_and_ordinary_paragraphs_are_not(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30) + "\n" + line + "\n" + prose(rng, 5), "en", "a") for i, line in enumerate(LINES)]
    rows += [(100 + i, line + "\n" + prose(rng, 30), "en", "a") for i, line in enumerate(ORDINARY)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (None, next(iter(LINES)), "en", "a"), (202, "\n".join(LINES), "en", "a"), (202, "\n".join(LINES), "en", "a"), *odd_rows()]
    got = license_scan.scan(table(spark, rows)).collect()
    want = [(i, 1, f) for i, f in enumerate(LINES.values())] + [(None, 0, "cc-by-nc")] + [(202, k, f) for k, f in enumerate(LINES.values())] * 2
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.paragraph, r.family) for r in got), key=key) == sorted(want, key=key)
    assert all(0.5 <= r.probability <= 1 and 0.6 <= r.template_share <= 1 for r in got)


def test_wrapped_notices_are_found_at_their_first_line(spark):
    rng = random.Random(3)
    model = license_scan.fit(ORDINARY + [prose(rng, 12) for _ in range(100)])
    rows, want = [], set()
    for i, (family, text) in enumerate((f, t) for f, texts in license_scan.NOTICES.items() for t in texts):
        for k, (width, mark) in enumerate([(72, ""), (60, "# "), (40, " * ")]):
            notice = [mark + x for x in textwrap.wrap(text + ".", width)]
            d = 10 * i + k
            rows.append((d, "\n".join([*[prose(rng, 8)] * 2, mark.strip(), *notice, mark.strip(), prose(rng, 8), prose(rng, 90)]), "en", "a"))
            alone = {(d, 3 + n, family) for n, x in enumerate(notice) if (slow_scan(model, x) or [""])[0] == family}
            want |= alone or {(d, 3, family)}
    assert sum(p == 3 for _, p, _ in want) > len(want) // 2
    rows += [(500 + i, prose(rng, 30) + "\n" + prose(rng, 30) + "\n" + line, "en", "a") for i, line in enumerate(ORDINARY)]
    got = [(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(table(spark, rows), model).collect()]
    assert set(got) == want and len(got) == len(want)


def slow_scan(model, line):
    """The model and the comparison on one paragraph, in plain Python."""
    w = license_scan.tokens(line)
    z = np.array(model.bias)
    for f in license_scan.features(w):
        z = z + np.array(model.weights.get(f, [0.0] * len(z)))
    z = z * model.scale
    p = np.exp(z - z.max())
    p /= p.sum()
    family = model.families[int(z.argmax())]
    pairs = license_scan.pairs(w)
    share = max((len(license_scan.pairs(t) & pairs) / len(license_scan.pairs(t)) for f, t in license_scan.TEMPLATES if f == family), default=0.0)
    return (family, float(p.max()), share) if family != "unknown" and p.max() >= 0.5 and share >= 0.6 else None


def test_scan_against_plain_python(spark):
    rng = random.Random(8)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t})
    lines = [*LINES, *ORDINARY, "MIT", "mit license", "Expat License"]
    lines += [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(150)]
    for _, t in license_scan.TEMPLATES:  # templates with words left out
        lines.append(" ".join(x for x in t if rng.random() < 0.85) + " " + rng.choice(words))
    model = license_scan.fit(ORDINARY * 3 + [prose(rng, 12) for _ in range(100)])
    got = {r.doc_id: (r.family, r.probability, r.template_share) for r in license_scan.scan(table(spark, [(i, x, "en", "a") for i, x in enumerate(lines)]), model).collect()}
    want = {i: f for i, x in enumerate(lines) if (f := slow_scan(model, x))}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[i][0] == want[i][0] and np.allclose(got[i][1:], want[i][1:]) for i in want)


def test_key_words_are_needed_for_every_template():
    for common in (set(), {w for _, t in license_scan.TEMPLATES for w in t}):
        keys = set(license_scan.key_words(common))
        for _, t in license_scan.TEMPLATES:
            p = license_scan.pairs(t)
            assert sum(not keys & set(x.split()) for x in p) < 0.6 * len(p)


def test_empty_table(spark):
    assert license_scan.scan(table(spark, [])).count() == 0


def test_query_finds_every_licence_line(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, k) for r in docs for k, x in enumerate((r.text or "").split("\n")) if "icense" in x or "rights reserved" in x}
    assert {(r.doc_id, r.paragraph) for r in QUERIES["op10_licenses"](spark, sf).collect()} == want and want


def test_the_sample_of_other_paragraphs_is_of_different_ones(spark):
    """One header line in every document: the other lines are sampled too, and the header once."""
    header = "This header stands at the top of every document of the corpus"
    docs = table(spark, [(i, f"{header}\nThe body of document number {i} is its own and no other's", "en", "a") for i in range(3000)])
    got = license_scan.sample_negatives(docs, limit=500)
    assert len(got) == len(set(got)) == 500

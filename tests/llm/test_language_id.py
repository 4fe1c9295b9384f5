import zlib

import numpy as np
from llm_fixtures import odd_rows, table

from vellum.llm import language_id
from vellum.llm.queries import QUERIES


def slow_vector(text):
    """Bundle of bound, shifted letter vectors, trigram by trigram."""
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    out = np.zeros(language_id.DIMS)
    for word in s.split():
        w = [0, *map(ord, word), 0]
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            v = [language_id.letter_vector(x) for x in (a, b, c)]
            out += np.roll(v[0], 2).astype(int) * np.roll(v[1], 1) * v[2]
    return out


def test_bundles_against_plain_loops():
    texts = ["The quick, brown fox!", "a", "", "12 34", "Straße ÉTÉ İx", "中文 字 \U00010400\U00010428 z", "x" * 50, "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]
    got = language_id.bundles([language_id.letters(t) for t in texts])
    for t, v in zip(texts, got, strict=True):
        assert np.allclose(v, slow_vector(t), atol=1e-3), t


def test_odd_documents_and_held_out_rows(spark):
    rows = odd_rows() + [(700 + i, "der die das und nicht", "de", "a") for i in range(20)]
    got = language_id.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in ("en", "fr", "de", "und") and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id in (100, 101, 102)} == {"und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = [(i, ("the house and the tree " if i % 2 else "das haus und der baum ") * 5, ("en", "de")[1 - i % 2], "a") for i in range(60)]
    wrong = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else x, s) for d, t, x, s in rows]
    a = sorted(map(tuple, language_id.identify(table(spark, rows)).collect()))
    assert a == sorted(map(tuple, language_id.identify(table(spark, wrong)).collect()))
    assert all(p == dict((r[0], r[2]) for r in rows)[d] for d, _, p, _ in a)


def test_nothing_learned_and_empty_table(spark):
    got = language_id.identify(table(spark, [(1, "abc", None, "a"), (None, "abc", "en", "a")])).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert language_id.identify(table(spark, [])).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    got = QUERIES["op5_language_id"](spark, sf).toPandas()
    held = got[got["held_out"]]
    assert len(held) > 200 and (held["lang_pred"] == docs[held["doc_id"]].to_numpy()).mean() > 0.97

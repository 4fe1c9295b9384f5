import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from llm_fixtures import odd_rows, prose, table

from vellum.llm import spelling

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def slow_counts(rows, thin):
    n = Counter()
    for doc, text, *_ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            if h % thin == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            n[r] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def slow(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {(w, form, root(w), n, k, fn) for w, (form, n, k, fn) in out.items()}


def rows(seed=2):
    rng = random.Random(seed)
    base = ["letters", "Größere", "aaaaaaa", "aaaaaabb", "abababab", "straßen", "mississippi", "÷×ÿÿÀÀ"]
    def typo(w):
        k, c = rng.randrange(len(w) + 1), rng.choice("abßÿ")
        return rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w, w.upper()])
    some = [typo(rng.choice(base)) for _ in range(60)] + [typo(typo(rng.choice(base))) for _ in range(60)]
    out = [(i, " ".join(rng.choice(rng.choice([base, some])) + rng.choice(["", ",", "1", "\n", "中"]) for _ in range(80)), "en", "a") for i in range(120)]
    out += [(500, "x" * 3000 + " " + "x" * 2999 + "y", "en", "a")] * 5 + [(501, prose(rng, 20_000), "en", "a")]
    out += [(700 + i, f"{w} " * k, "en", "a") for w, k in (("chainaa", 75), ("chainab", 15), ("chaixab", 3)) for i in (0, 1)]
    return out + odd_rows()


def as_words(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("thin", [199, 3])
def test_against_brute_force(spark, thin):
    words = slow_counts(rows(), thin)
    counts = spelling.word_counts(table(spark, rows()), thin=thin)
    assert dict(map(tuple, counts.collect())) == words
    got = [tuple(r) for r in spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(words) and set(got) == slow(words)
    assert any(r[1] for r in got) and any(r[1] != r[2] and r[1] for r in got)


@pytest.mark.parametrize("partition", [1, 3, 10_000])
def test_every_pair_once_whatever_the_partitions(spark, partition):
    rng = random.Random(7)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 50) for _ in range(400)}
    got = [frozenset(r) for r in spelling.near_pairs(as_words(spark, words), partition).collect()]
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptors_are_minimal_and_rank_their_words():
    words = sorted({"".join(w) for w in itertools.product("abc", repeat=3)} - {"abc", "cab"})
    m = spelling.Acceptors()
    start = m.add(words)
    assert m.size[start] == len(words) and m.add(words) == start
    assert len(m.arcs) <= 8  # 27 words of one shape would need four states, the two gaps add some
    def walk(s, at, u):
        if s == 0:
            assert words[u] == at
        for letter, to, rank in m.arcs[s]:
            walk(to, at + letter, u + rank)
    walk(start, "", 0)


def test_tasks_that_hand_their_words_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    monkeypatch.setattr(spelling, "ROWS", 3)
    words = slow_counts(rows(), 199)
    counts = spelling.word_counts(table(spark, rows()))
    assert dict(map(tuple, counts.collect())) == words
    assert {tuple(r) for r in spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n").collect()} == slow(words)


def test_chains_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("a", "w3"), ("b", "c")], "word string, form string")
    got = dict(map(tuple, spelling.roots(forms).collect()))
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "a": "w40", "b": "c"}


def test_empty_table(spark):
    assert spelling.variants(spelling.word_counts(table(spark, []))).collect() == []

"""Spelling variant grouping: composition of the vocabulary acceptor with a one-edit transducer and the acceptor again.

Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near word
with the most occurrences, if it has at least ``RATIO`` times as many; following forms leads to the root of a group.

The composition A . T . A accepts the pairs of near words. T has one state before the edit and one after it. Before the edit
both copies of A have read the same letters and stand in the same place; after it the rest must be common to both. So the
composition is split by where the edit is: with the code points of the shorter word numbered 0 to n, a window [i, j) holds
the pairs of length class n (words of n and n + 1 code points) whose edit is at i or later and before j. Such pairs agree
outside the window, that is, they share the initial state that is reached by the first i and the last n - j code points.
Words are dealt to these initial-state partitions (halves of the word, so two for each class), each task builds the
minimised acceptors of the middles of a partition, composes them through T lazily and enumerates the accepted pairs:
states that minimisation has merged have the same rest, so all of their words are pairs at once. An insertion into a run of
equal letters could be read in several places and is read at the end of the run, so every pair is accepted once.

Scale: texts are read once and counted in each task before the shuffle (tables of at most ``HELD`` words). Everything after
that works on the vocabulary: four rows for a word, dealt by the hash of the initial state. A partition of more than
``PARTITION`` words is split by halving its window, which lengthens what its words share, until it is small or the window is
one code point; no word is left out. Pairs are reduced to one row for a word in each partition before they leave the task.
Roots are found by doubling, so the rounds grow with the logarithm of the longest chain (and a form has five times the
occurrences, so chains are short).

Defined cases: a null text has no words, a null doc_id counts as an empty one; bytes that are no UTF-8 separate words;
repeated rows count as often as they occur; of forms with equally many occurrences the first in code-point order is taken;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import Rounds

# Fixed values of the contract.
LETTERS = "a-zÀ-ÿ"    # after A-Z were lower-cased
MIN_CHARS, MIN_COUNT = 6, 5
RATIO = 5
THIN = 199                      # a run whose crc32 this divides loses a code point

HELD = 300_000                  # words that a task counts before it hands them on
PARTITION = 20_000              # words of an initial-state partition
ROWS = 20_000                   # rows of a batch that leaves a task

Arcs = tuple[tuple[str, int, int], ...]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, thin: int = THIN) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points with at least ``min_count`` occurrences. A run of letters loses
    one code point where ``thin`` divides the crc32 of doc_id and run (0: never)."""
    run_of = re.compile(f"[{LETTERS}]{{{min_chars},}}")  # a shorter run cannot get longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                lower = (text.as_py() or b"").lower().decode("utf-8", "replace")  # lower() of bytes changes A-Z alone
                for word, n in Counter(run_of.findall(lower)).items():
                    h = zlib.crc32(word.encode(), start) if thin else 1
                    if thin and h % thin == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_chars:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shared(rows: DataFrame) -> DataFrame:
    """Adds ``state``: the hash of what a word shares with the others of its window."""
    after = F.col("size") - F.col("n") + F.col("j")  # where the shared rest of the word begins
    return rows.withColumn("state", F.xxhash64(F.expr("substr(word, 1, i)"), F.col("word").substr(after + 1, F.lit(1 << 30))))


def initial_states(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(n, i, j, state, word, count): the initial-state partitions of every word."""
    w = words.select("word", F.col("n").alias("count"), F.char_length("word").alias("size"))
    w = w.withColumn("n", F.explode(F.array("size", F.col("size") - 1))).where("n > 0")

    def halves(rows: DataFrame) -> DataFrame:
        middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
        win = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        both = F.explode(F.array(win(F.col("i"), middle), win(middle, F.col("j"))))
        return _shared(rows.select("word", "count", "size", "n", both.alias("win")).select("word", "count", "size", "n", "win.*")).where("j > i")

    rows = halves(w.withColumns({"i": F.lit(0), "j": F.col("n")}))
    key, done = ["n", "i", "j", "state"], None
    while True:
        large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("have")).where((F.col("have") > partition) & (F.col("j") - F.col("i") > 1))
        large = Rounds(words.sparkSession).cut(large.drop("have"))
        if large.isEmpty():
            break
        small = rows.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = Rounds(words.sparkSession).cut(halves(rows.join(large, key, "left_semi").drop("state")))
    return rows if done is None else rows.unionByName(done)


class Acceptors:
    """Minimised acyclic acceptors over one register of states. State 0 is the end; ``arcs`` of a state are sorted by letter
    and carry the rank of their first word, so that a path adds up to the rank of its word."""

    def __init__(self) -> None:
        self.arcs: list[Arcs] = [()]
        self.size = [1]
        self._register: dict[tuple, int] = {(): 0}

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        if key not in self._register:
            rank, ranked = 0, []
            for letter, to in arcs:
                ranked.append((letter, to, rank))
                rank += self.size[to]
            self._register[key] = len(self.arcs)
            self.arcs.append(tuple(ranked))
            self.size.append(rank)
        return self._register[key]

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted, different words of equal length."""
        path: list[list[tuple[str, int]]] = [[] for _ in range(len(words[0]) + 1)]
        last = words[0]
        for word in [*words[1:], ""]:
            common = 0
            while common < len(word) and word[common] == last[common]:
                common += 1
            for k in range(len(last), common, -1):  # no later word goes through these
                path[k - 1].append((last[k - 1], self._state(path[k])))
                path[k] = []
            last = word
        return self._state(path[0])

    def _rest(self, todo: list[tuple[int, int, int, int]], out: list[tuple[int, int]]) -> None:
        """After the edit: ranks of the words that two states have in common."""
        while todo:
            p, q, u, v = todo.pop()
            if p == q:
                out.extend((u + k, v + k) for k in range(self.size[p]))
                continue
            other = {letter: (to, rank) for letter, to, rank in self.arcs[q]}
            for letter, to, rank in self.arcs[p]:
                if letter in other:
                    there = other[letter]
                    todo.append((to, there[0], u + rank, v + there[1]))

    def replaced(self, start: int) -> list[tuple[int, int]]:
        """Pairs of ranks of words that differ in one letter."""
        out: list[tuple[int, int]] = []
        places = [(start, 0)]
        while places:
            s, u = places.pop()
            arcs = self.arcs[s]
            for k, (_, p, a) in enumerate(arcs):
                if self.size[p] > 1:
                    places.append((p, u + a))
                self._rest([(p, q, u + a, u + b) for _, q, b in arcs[k + 1:]], out)
        return out

    def deleted(self, long: int, short: int, at_end: bool) -> list[tuple[int, int]]:
        """Pairs of ranks of a word of ``long`` and the word of ``short`` left without one letter, the last of a run of equal
        letters; the last letter of all only if ``at_end``."""
        out: list[tuple[int, int]] = []
        places = [(long, short, 0, 0)]
        while places:
            s, t, u, v = places.pop()
            other = {letter: (to, rank) for letter, to, rank in self.arcs[t]}
            for letter, p, a in self.arcs[s]:
                if p == t == 0:
                    if at_end:
                        out.append((u + a, v))
                    continue
                self._rest([(q, other[x][0], u + a + b, v + other[x][1]) for x, q, b in self.arcs[p] if x != letter and x in other], out)
                if letter in other:
                    places.append((p, other[letter][0], u + a, v + other[letter][1]))
        return out


def accepted(n: int, i: int, j: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """The pairs of one window: words of n or n + 1 code points that agree outside of it."""
    short = sorted(x for x in words if len(x) == n)
    long = sorted(x for x in words if len(x) == n + 1)
    if not short or len(short) + len(long) < 2:
        return
    machine = Acceptors()
    a = machine.add([x[i:j] for x in short])
    if len(short) > 1:
        for x, y in machine.replaced(a):
            yield short[x], short[y]
    if long:
        for x, y in machine.deleted(machine.add([x[i:j + 1] for x in long]), a, j == n):
            yield long[x], short[y]


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, dict[str, int]]]:
    """Windows and their words with counts, from rows sorted by (n, i, j, state)."""
    key, held = None, {}

    def split() -> Iterator[tuple[int, int, int, dict[str, int]]]:
        n, i, j, _ = key
        same = defaultdict(dict)  # states of equal hash are told apart
        for word, count in held.items():
            same[word[:i], word[len(word) - n + j:]][word] = count
        yield from ((n, i, j, x) for x in same.values() if len(x) > 1)

    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("n", "i", "j", "state")]
        words, counts = b.column("word").to_pylist(), b.column("count").to_pylist()
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for start, end in zip([0, *new.tolist()], [*new.tolist(), len(words)], strict=True):
            of = tuple(int(c[start]) for c in cols) if end > start else key
            if of != key:
                if len(held) > 1:
                    yield from split()
                key, held = of, {}
            held.update(zip(words[start:end], counts[start:end], strict=True))
    if len(held) > 1:
        yield from split()


def _dealt(words: DataFrame, partition: int) -> DataFrame:
    key = ["n", "i", "j", "state"]
    rows = initial_states(words, partition).select(*key, "word", "count")
    return rows.repartition(*key).sortWithinPartitions(*key)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield make()
            held.clear()
    if held:
        yield make()


def near_pairs(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(a, b): every pair of near words of ``words`` (word, n), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (p for n, i, j, held in _partitions(batches) for p in accepted(n, i, j, list(held)))
        yield from _batches(found, pa.schema([("a", pa.string()), ("b", pa.string())]))

    return _dealt(words, partition).mapInArrow(run, "a string, b string")


def near_words(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(word, n_near, best_n, best): for words that have any, the number of near words and the one with most occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for n, i, j, held in _partitions(batches):
                near: dict[str, int] = defaultdict(int)
                best: dict[str, tuple[int, str]] = {}
                for pair in accepted(n, i, j, list(held)):
                    for x, y in (pair, pair[::-1]):
                        near[x] += 1
                        mine = (-held[y], y)
                        if x not in best or mine < best[x]:
                            best[x] = mine
                yield from ((x, k, best[x][0], best[x][1]) for x, k in near.items())

        yield from _batches(found(), pa.schema([("word", pa.string()), ("near", pa.int64()), ("less", pa.int64()), ("best", pa.string())]))

    parts = _dealt(words, partition).mapInArrow(run, "word string, near long, less long, best string")
    r = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    return r.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of each word of ``forms`` (word, form)."""
    rounds = Rounds(forms.sparkSession)
    cur = rounds.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = cur.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        cur = rounds.cut(cur.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        moved = not cur.where("moved").isEmpty()
        cur = cur.drop("moved")
        if not moved:
            return cur


def variants(words: DataFrame, ratio: int = RATIO, partition: int = PARTITION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n)."""
    spark = words.sparkSession
    words = Rounds(spark).cut(words)
    found = words.join(near_words(words, partition), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    table = Rounds(spark).cut(found.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                           F.when(has, F.col("best_n")).alias("form_n")))
    out = table.join(roots(table.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

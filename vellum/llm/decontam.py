"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

The index is of the test items, and every passage of every training document is a query against it. Index terms are
pairs of neighbouring words, so that common words alone never make a match. Impacts are BM25 impacts divided by the
item's score against itself: a passage that holds the whole item scores 1, and one threshold fits items of any length.
Passages are windows of twice the longest item's words that overlap by half, so each copy of an item lies whole in a
window. A window whose upper bound (sum of the terms' greatest impacts) stays under the threshold has no pivot and
ends there; the others run block-max WAND, which returns *all* items at or above the threshold.

Retrieved items are verified: shares of the question's and of the answer's words that stand in 5-word shingles that
the passage holds too must both reach ``MIN_OVERLAP``; a question or an answer of fewer than 5 words also counts if the
document holds all its words in a row, however far off. The answer is what follows the last question mark, or the last third of the words
where there is none. Labels, options or other words may stand between question and answer: the pair of words where
they meet is no index term, and the passage is verified together with a window's length of text before and after it.

Scale: one pass over the documents, no shuffle of texts; only matches leave the tasks. Items are cut into blocks of at
most ``INDEX_CHARS`` characters, each an index (and a broadcast) of bounded size and a pass of its own; statistics
(N, document frequencies, mean length) are those of the block.

Words are runs of letters and digits; in scripts without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each
character is a word. Items of 2 to 4 words match where a passage holds all their words in a row, items of one word where they
are a line of their own (anywhere else one word says nothing).

Defined cases: null or empty texts and items hold nothing; an item id that
occurs with several texts matches by any of them; an empty table on either side gives an empty result; repeated
document rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import drop_rows, text_key
from vellum.session import cut_lineage

SHINGLE = 5
MIN_OVERLAP = 0.8
THRESHOLD = 0.4        # of an item's score against itself
K1, B = 1.2, 0.75
BLOCK = 64             # postings in a block
MIN_WINDOW = 64
INDEX_CHARS = 32 << 20

# Characters of scripts without spaces.
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
            "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer."""
    at = max(text.rfind(mark) for mark in "?\uff1f") + 1
    q, a = tokens(text[:at]), tokens(text[at:])
    if q and a:
        return q, a
    w = q + a
    cut = len(w) - len(w) // 3
    return w[:cut], w[cut:]


class Index:
    """Postings (item, impact) for each pair of words, in item order, with the greatest impact of each block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.question, self.answer = [], [], []
        self.single: dict[str, list[int]] = {}  # items of one word
        bags = []
        for item, text in items:
            q, a = split_item(text or "")
            if len(q) + len(a) == 1:
                self.single.setdefault((q + a)[0], []).append(item)
            if len(q) + len(a) < 2:
                continue
            if len(q) + len(a) < SHINGLE:  # one part, matched as a whole
                q, a = q + a, []
            self.ids.append(item)
            self.question.append(q)
            self.answer.append(a)
            bags.append(Counter(pair for w in (q, a) for pair in zip(w, w[1:], strict=False)))
        self.words: dict[str, int] = {}
        for bag in bags:
            for pair in bag:
                for x in pair:
                    self.words.setdefault(x, len(self.words))
        n, size = len(bags), len(self.words)
        df = Counter(pair for bag in bags for pair in bag)
        mean = sum(sum(b.values()) for b in bags) / max(n, 1)
        post: dict[int, list[tuple[int, float]]] = {}
        for d, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            impact = {p: math.log1p((n - df[p] + 0.5) / (df[p] + 0.5)) * f * (K1 + 1) / (f + norm) for p, f in bag.items()}
            total = sum(impact.values())
            for (x, y), v in impact.items():
                post.setdefault(self.words[x] * size + self.words[y], []).append((d, v / total))
        self.codes = np.array(sorted(post), dtype=np.int64)
        self.post = [([d for d, _ in post[c]], [v for _, v in post[c]]) for c in self.codes.tolist()]
        self.block_max = [[max(v[i:i + BLOCK]) for i in range(0, len(v), BLOCK)] for _, v in self.post]
        self.bound = np.array([max(m) for m in self.block_max], dtype=np.float64)
        longest = max((len(q) + len(a) for q, a in zip(self.question, self.answer, strict=True)), default=0)
        self.window = max(MIN_WINDOW, 2 * longest)

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and term numbers of the word pairs of a text that the index has."""
        none = np.zeros(0, dtype=np.int64)
        if len(words) < 2 or not len(self.codes):
            return none, none
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[at] * len(self.words) + ids[at + 1]
        term = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[term] == code
        return at[hit], term[hit]

    def search(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) at or above ``theta`` for a query of distinct terms."""
        theta -= 1e-9
        cur = [[self.post[t][0][0], 0, t, float(self.bound[t])] for t in terms]  # next item, its place, term, bound
        found = []

        def advance(c: list, to: int) -> None:
            docs = self.post[c[2]][0]
            c[1] = bisect_left(docs, to, c[1])
            c[0] = docs[c[1]] if c[1] < len(docs) else None

        while cur:
            cur.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cur):
                total += c[3]
                if total >= theta:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            near, until = 0.0, cur[pivot + 1][0] if pivot + 1 < len(cur) else math.inf
            for c in cur[:pivot + 1]:
                docs = self.post[c[2]][0]
                place = bisect_left(docs, item, c[1])
                if place < len(docs):
                    block = place // BLOCK
                    near += self.block_max[c[2]][block]
                    until = min(until, docs[min((block + 1) * BLOCK, len(docs)) - 1] + 1)
            if near < theta:  # no item before the end of these blocks can reach the threshold
                moved = [c for c in cur[:pivot + 1]]
                for c in moved:
                    advance(c, max(until, item + 1) if until != math.inf else item + 1)
            elif cur[0][0] == item:
                score = sum(self.post[c[2]][1][c[1]] for c in cur[:pivot + 1])
                if score >= theta:
                    found.append((item, score))
                for c in cur[:pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cur[:pivot + 1]:
                    if c[0] < item:
                        advance(c, item)
            cur = [c for c in cur if c[0] is not None]
        return found

    def overlap(self, item: int, passage: set, text: str) -> tuple[float, float]:
        """Shares of the question's and the answer's words inside 5-word shingles of the passage; a part of fewer words
        is inside if ``text``, the document's words between single spaces, holds it in a row."""
        q, a = self.question[item], self.answer[item]
        w, inside = q + a, np.zeros(len(q) + len(a), dtype=bool)
        for i in range(len(w) - SHINGLE + 1):
            if tuple(w[i:i + SHINGLE]) in passage:
                inside[i:i + SHINGLE] = True
        for part, at in ((q, slice(0, len(q))), (a, slice(len(q), len(w)))):
            if 0 < len(part) < SHINGLE and f" {' '.join(part)} " in text:
                inside[at] = True
        share = lambda x: float(x.mean()) if len(x) else 1.0
        return share(inside[:len(q)]), share(inside[len(q):])

    def matches(self, text: str | None, theta: float, min_overlap: float) -> list[tuple]:
        """(item id, score, question overlap, answer overlap, first word of the passage): the best passage of each item."""
        words = tokens(text)
        alone = self.alone(text, words) if self.single else []
        at, term = self.terms(words)
        if not len(at):
            return alone
        bound = np.concatenate([[0.0], np.cumsum(self.bound[term])])
        step = self.window // 2
        starts = np.arange(0, max(len(words) - step, 1), step)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + self.window - 1)
        best: dict[int, tuple] = {}
        around = ""
        for k in np.flatnonzero(bound[hi] - bound[lo] >= theta - 1e-9):
            hits = self.search(sorted(set(term[lo[k]:hi[k]].tolist())), theta)
            if not hits:
                continue
            p = words[max(starts[k] - self.window, 0):starts[k] + 2 * self.window]
            shingles = set(zip(*(p[i:] for i in range(SHINGLE)), strict=False))
            around = around or f" {' '.join(words)} "
            for item, score in hits:
                q, a = self.overlap(item, shingles, around)
                row = (min(score, 1.0), q, a, -int(starts[k]))
                if min(q, a) >= min_overlap and row > best.get(item, ()):
                    best[item] = row
        out: dict[int, tuple] = {}
        for item, row in best.items():
            out[self.ids[item]] = max(row, out.get(self.ids[item], ()))
        return alone + [(i, s, q, a, -p) for i, (s, q, a, p) in out.items()]

    def alone(self, text: str | None, words: list[str]) -> list[tuple]:
        """Matches of items of one word: a line that has this word and no other."""
        if not any(w in self.single for w in words):
            return []
        out, first = {}, 0
        for line in (text or "").split("\n"):
            w = tokens(line)
            if len(w) == 1:
                for item in self.single.get(w[0], ()):
                    out.setdefault(item, (item, 1.0, 1.0, 1.0, first))
            first += len(w)
        return list(out.values())


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """Test items in blocks of bounded size; each is fetched alone, by a range of a hash of the item."""
    it = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = it.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // INDEX_CHARS + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[tuple(r) for r in it.where(part == k).orderBy("item_id", "text").collect()] for k in range(n)] if chars else []


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, k_text, item_id, score, question_overlap, answer_overlap, passage_start), a row for each match."""
    schema = ("doc_id long, k_text long, item_id long, score double, question_overlap double, answer_overlap double, "
              "passage_start long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k_text"), "text")
    spark, out = docs.sparkSession, None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = [(d, k, *m) for d, k, t in zip(b.column("doc_id").to_pylist(), b.column("k_text").to_pylist(), b.column("text"), strict=True)
                         for m in index.matches(t.as_py(), threshold, min_overlap)]
                if found:
                    cols = list(zip(*found, strict=True))
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                     names=[x.split()[0] for x in schema.split(", ")])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay."""
    hit = cut_lineage(contaminated(docs, items).select(F.col("doc_id").alias("k_doc"), "k_text").distinct())
    return drop_rows(docs, hit)

"""Language ID: hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds the vectors of its
three letters, each shifted (permuted) by its place, by element-wise multiplication. A text's vector bundles, that is
adds, the vectors of all its trigrams; a language's prototype bundles the training texts of that language. A document
gets the language whose prototype has the greatest cosine with its vector.

Scale: two passes over the texts (training, prediction) in Arrow batches. Training leaves each task as one vector for
each language, summed by Spark; the prototypes are languages x ``DIMS`` numbers, a few kilobytes for each language, and
are what is sent to the tasks. No text is shuffled, so hot sources and copies need no care. Prediction sees the text only.

Letters are alphabetic characters in lower case; everything else is a boundary between words. Bundling counts whole
texts: trigram counts of up to ``BATCH`` texts are multiplied with the trigram vectors at a time.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned;
a one-letter word is the trigram of the letter between boundaries; null doc_ids and null langs are not learned from; of
equal cosines the first language in order wins; repeated rows count as often as they occur; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1024
SEED = 1009
BATCH = 64
BATCH_CHARS = 1 << 18
TRIGRAMS = 1 << 13       # trigram vectors made at a time
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    """The random vector of a code point; 0 is the boundary between words."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMS, dtype=np.int8)
    return bits * 2 - 1


def letters(text: str | None) -> np.ndarray:
    """Code points of letters with one 0 between words and at both ends; empty if there is no letter."""
    cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = cps < 0x10000
    is_letter = np.zeros(len(cps), dtype=bool)
    is_letter[low] = _alphabetic()[cps[low]]
    for i in np.flatnonzero(~low):
        is_letter[i] = chr(cps[i]).isalpha()
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64)
    s = np.concatenate([[0], np.where(is_letter, cps, 0).astype(np.int64), [0]])
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def bundles(texts: list[np.ndarray]) -> np.ndarray:
    """The bundled vector of each letter sequence (rows of float64)."""
    out = np.zeros((len(texts), DIMS))
    full = [k for k, s in enumerate(texts) if len(s) > 2]
    if not full:
        return out
    joined = np.concatenate([texts[k] for k in full])
    alphabet, s = np.unique(joined, return_inverse=True)
    a = len(alphabet)
    code = (s[:-2] * a + s[1:-1]) * a + s[2:]
    row = np.repeat(np.arange(len(full)), [len(texts[k]) for k in full])
    inside = (row[:-2] == row[2:]) & (joined[1:-1] != 0)  # not across texts; the middle is a letter
    code, row = code[inside], row[:-2][inside]
    if a ** 3 <= 1 << 17:  # few different letters: the table of all trigrams is small
        counts = np.bincount(row * a ** 3 + code, minlength=len(full) * a ** 3).reshape(len(full), a ** 3)
        used = np.flatnonzero(counts.any(axis=0))
        counts = counts[:, used]
    else:
        used, place = np.unique(code, return_inverse=True)
        counts = np.bincount(row * len(used) + place, minlength=len(full) * len(used)).reshape(len(full), len(used))
    base = np.stack([letter_vector(int(c)) for c in alphabet])
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for at in range(0, len(used), TRIGRAMS):
        u = used[at:at + TRIGRAMS]
        vectors = first[u // (a * a)] * second[u // a % a] * base[u % a]
        out[full] += counts[:, at:at + TRIGRAMS].astype(np.float32) @ vectors.astype(np.float32)
    return out


def _batches(texts: list[np.ndarray]) -> Iterator[slice]:
    """Slices of at most ``BATCH`` texts and, a longer text apart, ``BATCH_CHARS`` letters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < BATCH and (end == at or size + len(texts[end]) <= BATCH_CHARS):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(rows: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) from rows (lang, text), lang being non-null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text")
            for lang in set(langs):
                found = [letters(t.as_py()) for x, t in zip(langs, texts, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(DIMS))
                for part in _batches(found):  # the texts of a batch make one bundle; a boundary keeps them apart
                    total += bundles([np.concatenate([np.zeros(1, np.int64), *found[part]])])[0]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * DIMS, "i": list(range(DIMS)), "v": v}, schema=arrow)

    arrow = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("v", pa.float64())])
    parts = rows.select("lang", "text").mapInArrow(run, "lang string, i int, v double")
    total = parts.groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors = total.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    out = {}
    for r in vectors.collect():  # languages x DIMS
        v = np.array(r["v"])
        if np.linalg.norm(v) > 0:
            out[r["lang"]] = v / np.linalg.norm(v)
    return out


def predict(rows: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for rows (doc_id, held_out, text)."""
    names = sorted(prototypes)
    shared = rows.sparkSession.sparkContext.broadcast((names, np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known = shared.value
        for b in batches:
            texts = [letters(t.as_py()) for t in b.column("text")]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for part in _batches(texts):
                v = bundles(texts[part])
                norm = np.linalg.norm(v, axis=1)
                for k in np.flatnonzero(norm > 0) if langs else ():
                    cos = known @ v[k] / norm[k]
                    best[part.start + k] = langs[int(cos.argmax())]
                    score[part.start + k] = min(max(float(cos.max()), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(best, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each input row, learning from the rows not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    train = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(rows, learn(train))

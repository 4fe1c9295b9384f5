"""SimHash near-dedup through anchor points of a covering code.

A document's fingerprint has bit i set if more than half of its shingle hashes have it set. Two fingerprints are
linked if they differ in at most ``max_bits`` bits, and a document's component is what it can reach over links.

Finding the links. The anchors are the code words of the perfect Hamming code on bits 0..62 (covering radius 1; the
last bit is left to the comparison). Every fingerprint is replicated to all anchors within the covering radius plus
its share of the threshold, ``ceil(max_bits / 2)``: for two fingerprints at ``max_bits`` or less there is a word half
way between them, at most that many bits from either, and the anchor nearest to that word is within the radius of it.
So every linked pair meets at an anchor, while the other form, in which one side stays at its nearest anchor and the
other is replicated over the whole threshold, would need 20 times the replicas. With the syndrome s of a fingerprint
(the exclusive or of the numbers of its set bits, 1..63) the anchors within distance 2 are: itself if s = 0, otherwise
flip bit s, or any two bits whose numbers have the exclusive or s - 32 in all. One anchor serves at most 4,034
different fingerprints, whatever the input, so no group can grow without bound, and copies are merged beforehand.

Cost: one pass over the texts, 32 narrow rows for each *different* fingerprint, and a link table for the components.

Defined cases: a text of fewer words than a shingle counts as one shingle of all its words; a text without a word, or
null, has fingerprint 0, which links like any other; rows with a null doc_id take part, and component ids are the
least non-null doc_id (null if there is none); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import drop_rows, text_key
from vellum.llm.components import components
from vellum.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BLOCK = 1 << 16  # hashes whose bits are counted at a time, which bounds memory for very long texts


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a whole text as an unsigned number."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < shingle_words:
        h = np.array([digest(b" ".join(w), SEED)], dtype="<u8")
    else:
        h = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(w[k:] for k in range(shingle_words)), strict=False))),
                        dtype="<u8", count=len(w) - shingle_words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at:at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, k_text, fp), one row for each input row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle_words) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k_text"), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "k_text", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k_text"), "text")
    return rows.mapInArrow(run, "doc_id long, k_text long, fp long")


def _syndrome(fp: Column) -> Column:
    """Exclusive or of the numbers 1..63 of the set bits among bits 0..62, from six parities."""
    out = F.lit(0)
    for j in range(6):
        mask = sum(1 << (n - 1) for n in range(1, 64) if n >> j & 1)
        out = out + F.bit_count(fp.bitwiseAND(F.lit(mask).cast("long"))) % 2 * (1 << j)
    return out


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at all anchors within distance 2 on bits 0..62."""
    def bit(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), n - 1)

    flips = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: i.bitwiseXOR(F.col("s")) < i),
        lambda i: F.col("low").bitwiseXOR(bit(i)).bitwiseXOR(
            F.when(i == F.col("s"), F.lit(0).cast("long")).otherwise(bit(i.bitwiseXOR(F.col("s"))))))
    at = F.when(F.col("s") == 0, F.array("low")).otherwise(flips)
    low = F.col("fp").bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
    return fps.select("fp", low.alias("low"), _syndrome(F.col("fp")).alias("s")).select("fp", F.explode(at).alias("anchor"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: different fingerprints of ``fps`` (column fp, distinct) within ``max_bits`` (2 at most)."""
    if max_bits > 2:
        raise ValueError("the code used here covers thresholds of up to 2 bits")
    at = anchors(fps)
    x, y = at.select("anchor", F.col("fp").alias("a")), at.select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return x.join(y, "anchor").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, k_text, fp, root, component_id), one row for each input row; root names the component."""
    rows = cut_lineage(fingerprints(docs, shingle_words))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), max_bits))
    member = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = member.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select("doc_id", "k_text", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (nulls last), then of the least text key."""
    v = cut_lineage(near_duplicates(docs, shingle_words, max_bits))
    first = v.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_text")).alias("f"))
    chosen = first.select(F.col("root").alias("f_root"), F.col("f.doc_id").alias("f_doc"), F.col("f.k_text").alias("f_text"))
    is_chosen = (F.col("root") == F.col("f_root")) & F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("k_text") == F.col("f_text"))
    gone = v.join(chosen, is_chosen, "left_anti")
    kept = drop_rows(docs, gone.select(F.col("doc_id").alias("k_doc"), F.col("k_text")))
    again = (v.join(chosen, is_chosen, "left_semi").groupBy("doc_id", "k_text").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("doc_id").alias("k_doc"), F.col("k_text")))
    # only rows that occur more than once go through an aggregate on whole rows
    same = kept["doc_id"].eqNullSafe(again["k_doc"]) & (text_key(kept["text"]) == again["k_text"])
    twice = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return drop_rows(kept, again).unionByName(twice)

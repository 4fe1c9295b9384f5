"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold and
put the others together by position.

A line's key is the line without white space at both ends, A-Z in lower case. A key of at least ``MIN_CHARS`` characters
found in at least ``MIN_DOCS`` documents is boilerplate: its lines go, save those in the greatest doc_id that holds it.
DataFrame functions only.

Scale: texts are read twice, once for the hashes of long lines (two 64-bit hashes a line) and once to cut the texts.
Counting goes through (hash, doc_id) first, combined map-side, so that a line in a third of all documents is spread over
all tasks. Of the lines only dropped positions are joined back, as one sorted array for each document; cutting is linear
in the lines of a text. The join on hashes has one row for each on its other side, which is broadcast behind a count;
beyond that the engine joins by hash and splits hot ones.

Defined cases: a null or empty text is one empty line; rows without a doc_id neither count nor lose lines; rows that
share a doc_id are one document for the count, and each loses its own lines; an empty table gives an empty result;
other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SPACE_CHARS, ascii_lower, small, text_key
from vellum.session import cut_lineage

MIN_CHARS = 40
MIN_DOCS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k_text, pos, h1, h2): the hashed key of every line that is long enough."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", text_key(F.col("text")).alias("k_text"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars)
    rows = rows.withColumn("key", F.btrim("line", F.lit(SPACE_CHARS))).where(F.length("key") >= min_chars)
    rows = rows.withColumn("key", ascii_lower(F.col("key")))
    return rows.select("doc_id", "k_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, k_text, gone): ascending positions of the lines that go, for documents that lose any."""
    lines = cut_lineage(long_lines(docs, min_chars))
    once = lines.select("h1", "h2", "doc_id").distinct()
    seen = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    seen = small(cut_lineage(seen.select("h1", "h2", "last")))
    gone = lines.join(seen, ["h1", "h2"]).where("doc_id <> last")
    return gone.groupBy("doc_id", "k_text").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _cut(lines: Column, gone: Column) -> Column:
    """``lines`` without the positions ``gone``: the stretches between them, one after the other."""
    n = F.size(gone)

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))


def _joined(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    gone = dropped_positions(docs, min_chars, min_docs).select(F.col("doc_id").alias("k_doc"), "k_text", "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    j = rows.join(gone, (F.col("row.doc_id") == F.col("k_doc")) & (text_key(F.col("row.text")) == F.col("k_text")), "left")
    j = j.select("row", "gone", _lines(F.col("row.text")).alias("lines"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
        F.array_join(_cut(F.col("lines"), F.col("gone")), "\n"))
    return j.select("row", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): one row for each input row, text being what is left."""
    j = _joined(docs, min_chars, min_docs)
    return j.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("text"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines cut out of ``text``; all columns stay."""
    j = _joined(docs, min_chars, min_docs)
    return j.select(*[F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, and its complement (both ASCII only).
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of one byte per character take the fast path of ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id but not a text apart; equal rows have equal keys (and equal decisions)."""
    return F.xxhash64(text)


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose (doc_id, text key) is in ``dropped`` (columns k_doc, k_text).

    Null ids compare equal. The engine broadcasts ``dropped`` only if it measures it as small at run time.
    """
    k = dropped.select("k_doc", "k_text").distinct()
    on = docs["doc_id"].eqNullSafe(k["k_doc"]) & (text_key(docs["text"]) == k["k_text"])
    return docs.join(k, on, "left_anti")


#: Rows of a few narrow columns that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Marks a materialised table of narrow rows for broadcast if it has at most ``BROADCAST_ROWS`` rows (of which
    one more is counted at most). Beyond that the engine's own join stands, which splits hot keys at run time."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

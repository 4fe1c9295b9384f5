"""Corpus search: regex with line numbers, id-only search, predicates.

Every operator is a narrow projection/filter over the corpus scan: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.arrays import explode_rows
from vellum.functions.regex import line_hits, match_lines, with_flags


def regex_lines(entities: DataFrame, pattern: str, flags: int = 0, keep_empty: bool = False) -> DataFrame:
    """F9 (and F13 with ``keep_empty``): ``(entity_id, lines)`` with one entry per match.

    ``lines`` holds the 1-based line of each match start, in order; entities without a match are
    omitted unless ``keep_empty``.
    """
    pat = with_flags(pattern, flags)
    out = entities.select("entity_id", match_lines(F.col("program"), pat).alias("lines"))
    if keep_empty:
        return out
    # rlike first: the cheap test prunes rows before the marking pass.
    return (
        entities.where(F.col("program").rlike(pat))
        .select("entity_id", match_lines(F.col("program"), pat).alias("lines"))
    )


def regex_line_hits(entities: DataFrame, pattern: str, flags: int = 0) -> DataFrame:
    """F9 in long form: ``(entity_id, line, hits)``, one row per line holding at least one match start."""
    pat = with_flags(pattern, flags)
    hits = explode_rows(entities.where(F.col("program").rlike(pat)), line_hits(F.col("program"), pat), "h", "entity_id")
    return (
        hits.select("entity_id", F.col("h.line").cast("int").alias("line"), F.col("h.hits").cast("int").alias("hits"))
    )


def regex_ids(entities: DataFrame, pattern: str, flags: int = 0) -> DataFrame:
    """ids of entities with at least one match."""
    return entities.where(F.col("program").rlike(with_flags(pattern, flags))).select("entity_id")


def does_match(text: Column, pattern: str, flags: int = 0) -> Column:
    """find at least once."""
    return text.rlike(with_flags(pattern, flags))


def matches_at_least_one(text: Column, patterns: Sequence[str], flags: int = 0) -> Column:
    """OR of F11 over several patterns (false for an empty list)."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(with_flags(p, flags))
    return out


def per_line_matches(entities: DataFrame, pattern: str, flags: int = 0) -> DataFrame:
    """0-based numbers of the lines that match on their own (once per line).

    Lines come from ``split(text, '\\n')`` with trailing empty lines dropped, as a Java split does.
    """
    pat = with_flags(pattern, flags)
    trimmed = F.regexp_replace("program", r"\n+\z", "")
    lines = (
        F.when(F.col("program") == "", F.array(F.lit("")))
        .when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, "\n", -1))
    )
    return (
        explode_rows(entities, lines, "line", "entity_id", pos="line_index")
        .where(F.col("line").rlike(pat))
        .select("entity_id", F.col("line_index").cast("int").alias("line_index"))
    )

"""Small inputs with every odd case: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fp long, "
          "size long, copies int, cut string, row string, k_text long, k_doc long, rid long, h long, pos int")
EXTRA = (7, True, 1, 2, 3, "x", "y", 4, 5, 6, 8, 9)


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text, lang, source) as ``documents`` with columns whose names clash with the operators' own."""
    full = [(d, t, lang, s, None if t is None else len(t), *EXTRA) for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    vocabulary = [f"{a}{b}" for a in ("ta", "ri", "mo", "len", "sor", "ka", "vi", "pol") for b in ("ne", "ska", "ro", "ti", "um", "al", "es")]
    return " ".join(rng.choice(vocabulary) + (str(rng.randrange(size)) if rng.random() < 0.3 else "") for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 3 else prose(rng, 40 + i), ("en", "fr", None)[i % 3], ("a", "b", None)[i % 4 % 3]) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, " \n\t ", "fr", "b"), (103, "one", "en", "a"), (104, "one two", "en", "a"),
             (105, prose(rng, 30_000), "en", "a"), (106, "Ünïcode ſtraße 中文 \U0001f600 K", "de", "c"),
             (None, base[1], "en", "a"), (None, None, None, None), (107, base[1], "en", "a"), (107, base[1], "en", "a"), (107, base[2], "en", "a")]
    return rows

"""Regular-expression helpers: flag translation and match positions as line numbers.

Matching uses Java regex *find* semantics, as ``regexp_replace`` / ``rlike`` do on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Java.util.regex.Pattern flag bits and their inline forms.
# ---------------------------------------------------------------------------------------------
FLAG_UNIX_LINES = 0x01  # (?d)
FLAG_CASE_INSENSITIVE = 0x02  # (?i)
FLAG_COMMENTS = 0x04  # (?x)
FLAG_MULTILINE = 0x08  # (?m)
FLAG_LITERAL = 0x10  # no inline form: quote the pattern
FLAG_DOTALL = 0x20  # (?s)
FLAG_UNICODE_CASE = 0x40  # (?u)
FLAG_CANON_EQ = 0x80  # no inline form: rejected
FLAG_UNICODE_CHARACTER_CLASS = 0x100  # (?U)

INLINE_FLAGS = (
    (FLAG_UNIX_LINES, "d"),
    (FLAG_CASE_INSENSITIVE, "i"),
    (FLAG_COMMENTS, "x"),
    (FLAG_MULTILINE, "m"),
    (FLAG_DOTALL, "s"),
    (FLAG_UNICODE_CASE, "u"),
    (FLAG_UNICODE_CHARACTER_CLASS, "U"),
)

# Private-use character put before every match start. A text may hold it itself: see :func:`_hits_per_line`.
MARK = "\ue000"


def with_flags(pattern: str, flags: int = 0) -> str:
    """Turn a pattern plus a flag bit set into one pattern string with inline flags."""
    if flags & FLAG_CANON_EQ:
        raise ValueError("CANON_EQ has no inline form and is not supported")
    known = FLAG_LITERAL | FLAG_CANON_EQ
    for bit, _ in INLINE_FLAGS:
        known |= bit
    if flags & ~known:
        raise ValueError(f"unknown regex flag bits: {flags & ~known:#x}")
    body = pattern
    if flags & FLAG_LITERAL:
        body = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    inline = "".join(ch for bit, ch in INLINE_FLAGS if flags & bit)
    return f"(?{inline}){body}" if inline else body


def match_marked(text: Column, pattern: str) -> Column:
    """Text with ``MARK`` inserted before every match start (Java find semantics, zero-width included)."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0"))


def _hits_per_line(text: Column, pattern: str) -> Column:
    """Array of the number of matches that start in each line.

    Marks are only ever added, and no match adds a line break: the lines of the marked text are those of the text,
    and a line has as many matches as it has gained marks."""
    marks = lambda line: F.size(F.split(line, MARK, -1))
    marked = F.split(match_marked(text, pattern), "\n", -1)
    return F.zip_with(marked, F.split(text, "\n", -1), lambda m, t: marks(m) - marks(t))


def match_lines(text: Column, pattern: str) -> Column:
    """1-based line of every match start, in order, repeated when a line holds several matches.

    The text is marked once, split into lines, and the marks that line ``i`` gains yield ``i`` that many
    times. Linear in the text length, entirely inside one row (no shuffle).
    """
    return F.flatten(F.transform(_hits_per_line(text, pattern), lambda n, i: F.array_repeat(i + 1, n)))


def line_hits(text: Column, pattern: str) -> Column:
    """Per line with at least one match: struct(line, hits). Same work as :func:`match_lines`."""
    counted = F.transform(
        _hits_per_line(text, pattern), lambda n, i: F.struct((i + 1).alias("line"), n.alias("hits"))
    )
    return F.filter(counted, lambda s: s["hits"] > 0)

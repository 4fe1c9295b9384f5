"""Scalar column functions (native Spark expressions only; no Python UDFs).

Every function takes and returns :class:`pyspark.sql.Column` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------------------------
# Time budget for a run: runtime (ms) times 5, in seconds, clamped to [10, 600].
BUDGET_FACTOR = 5
BUDGET_MIN_SECONDS = 10
BUDGET_MAX_SECONDS = 600
# Length of the hex digest kept for a node hash (first 16 of the 32 MD5 hex characters).
HASH_HEX_CHARS = 16
# Back-end options stripped from argument lists before a re-run.
STRIP_FLAGS_SYMBOLIC = (
    "--timeout",
    "--cvc5Exe",
    "--enableTempDirectory",
    "--mapAxiomatizationFile",
    "--multisetAxiomatizationFile",
    "--printMethodCFGs",
    "--proverLogFile",
    "--sequenceAxiomatizationFile",
    "--setAxiomatizationFile",
    "--submitForEvaluation",
    "--tempDirectory",
    "--z3Exe",
    "--z3LogFile",
)
STRIP_FLAGS_VCGEN = ("--timeout", "--boogieExe", "--proverLog", "--z3Exe")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def loc(text: Column | str) -> Column:
    """C1 lines of code: number of pieces of ``text.split("\\n")`` with trailing empty pieces dropped.

    ``""`` gives 1 (one empty piece), a text of only newlines gives 0.
    """
    t = _col(text)
    trimmed = F.regexp_replace(t, r"\n+\z", "")
    return (
        F.when(t == "", F.lit(1))
        .when(trimmed == "", F.lit(0))
        .otherwise(F.size(F.split(trimmed, "\n", -1)))
        .cast("int")
    )


def offset_to_line(text: Column | str, offset: Column | str) -> Column:
    """1-based line of the 0-based character ``offset`` = newlines before it + 1."""
    prefix = F.substring(_col(text), 1, _col(offset))
    return (F.length(prefix) - F.length(F.regexp_replace(prefix, "\n", "")) + 1).cast("int")


def short_md5(value: Column | str) -> Column:
    """First 16 hex characters of the MD5 digest of the UTF-8 bytes."""
    return F.substring(F.md5(_col(value)), 1, HASH_HEX_CHARS)


def strip_option(args: Column, flag: str) -> Column:
    """C4 for one flag: drop its first occurrence; also drop the next element unless that starts with ``--``."""
    return _strip_expr(args, F.lit(flag))


def _strip_expr(acc: Column, f: Column) -> Column:
    pos = F.array_position(acc, f).cast("int")
    nxt = F.try_element_at(acc, pos + 1)
    takes_value = (pos < F.size(acc)) & ~F.coalesce(nxt.startswith("--"), F.lit(False))
    width = F.when(takes_value, F.lit(2)).otherwise(F.lit(1))
    before = F.slice(acc, F.lit(1), F.greatest(pos - 1, F.lit(0)))
    after_start = pos + width
    after = F.slice(acc, after_start, F.greatest(F.size(acc) - after_start + 1, F.lit(0)))
    return F.when(pos == 0, acc).otherwise(F.concat(before, after))


def strip_options(args: Column | str, flags: Sequence[str] = STRIP_FLAGS_SYMBOLIC) -> Column:
    """C4: fold :func:`strip_option` over a list of flags with ``aggregate`` (no nested expression blow-up)."""
    flag_arr = F.array(*[F.lit(f) for f in flags])
    return F.aggregate(flag_arr, _col(args), _strip_expr)


def rerun_args(
    extra_args: Column,
    args: Column | str,
    from_backend: Column,
    timeout_seconds: Column | None = None,
    flags: Sequence[str] = STRIP_FLAGS_SYMBOLIC,
) -> Column:
    """Extra args, plus the original args only when the entity came from this back end, stripped (C4);
    then ``--timeout n`` appended when a timeout is given."""
    empty = F.array().cast("array<string>")
    base = strip_options(F.concat(extra_args, F.when(from_backend, _col(args)).otherwise(empty)), flags)
    if timeout_seconds is None:
        return base
    return F.concat(base, F.array(F.lit("--timeout"), timeout_seconds.cast("string")))


def time_budget(runtime_ms: Column | str) -> Column:
    """``min(max(int(runtime * 5 / 1000), 10), 600)`` seconds."""
    raw = (_col(runtime_ms) * float(BUDGET_FACTOR) / 1000.0).cast("int")
    return F.least(F.greatest(raw, F.lit(BUDGET_MIN_SECONDS)), F.lit(BUDGET_MAX_SECONDS))


def rerun_budget(runtime_ms: Column | str) -> Column:
    """The unclamped budget used for re-runs (0 means no limit)."""
    return (_col(runtime_ms) * float(BUDGET_FACTOR) / 1000.0).cast("int")


def millis_to_timestamp(ms: Column | str) -> Column:
    """Epoch milliseconds to a timestamp without time zone."""
    return F.timestamp_millis(_col(ms)).cast("timestamp_ntz")


def error_id_set(errors: Column | str) -> Column:
    """Sorted distinct error ids of a result (the "error id set")."""
    return F.array_sort(F.array_distinct(F.transform(_col(errors), lambda e: e["error_id"])))


def has_timeout_error(errors: Column | str, timeout_kind: str = "timeout") -> Column:
    """C14: any error whose id names the timeout kind."""
    return F.exists(_col(errors), lambda e: F.lower(e["error_id"]).contains(timeout_kind))


def runtime_differs(a: Column | str, b: Column | str, factor: float = 1.5) -> Column:
    """``a <= b / k or a >= b * k``."""
    a, b = _col(a), _col(b)
    return (a <= b / F.lit(factor)) | (a >= b * F.lit(factor))


def as_json(*cols: Column | str) -> Column:
    """A JSON object for an entry point response."""
    return F.to_json(F.struct(*[_col(c) for c in cols]))


def with_field(struct_col: Column | str, name: str, value: Column) -> Column:
    """Copy of a struct with one field replaced."""
    return _col(struct_col).withField(name, value)


def phase_durations(phases: Column | str) -> Column:
    """W3 on one result: duration of each phase = cumulative time minus the previous cumulative time.

    ``phases`` is ``array<struct<phase string, millis bigint>>`` with cumulative millis.
    """
    p = _col(phases)
    return F.transform(
        p,
        lambda x, i: F.struct(
            x["phase"].alias("phase"),
            (x["millis"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(p, i)["millis"])).alias("millis"),
        ),
    )

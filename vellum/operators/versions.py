"""Comparing two versions of a back end.

The reference compares two in-memory result lists with quadratic ``exists`` loops. Here every
"exists a v2 result of the same entity with property P" is rewritten exactly into a one-row-per-entity
summary of v2 (min/max/bool_or), then an equi-join on entity id: linear work, and an entity holding a
third of all results is pre-aggregated map-side before any shuffle instead of being paired row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.scalars import error_id_set, rerun_budget
from vellum.session import cut_lineage

DEFAULT_TIME_FACTOR = 1.5


def missing_version(entities: DataFrame, results: DataFrame, version_hash: str) -> DataFrame:
    """Entity ids without any result for ``version_hash`` (NOT EXISTS as a left anti join)."""
    # distinct first: an entity with a third of all results collapses map-side to one build-side row
    have = results.where(F.col("version_hash") == F.lit(version_hash)).select("entity_id").distinct()
    return entities.select("entity_id").join(have, "entity_id", "left_anti")


def rerun_backlog(entities: DataFrame, results: DataFrame, version_hash: str) -> DataFrame:
    """K6: the backlog of J3 with the (unclamped) re-run budget of each entity."""
    ids = missing_version(entities, results, version_hash)
    return entities.join(ids, "entity_id", "left_semi").select(
        "entity_id", rerun_budget("original_runtime").alias("timeout_seconds")
    )


def _side(results: DataFrame, version_hash: str) -> DataFrame:
    return results.where(F.col("version_hash") == F.lit(version_hash))


def shared_entities(results: DataFrame, v1: str, v2: str) -> DataFrame:
    """Entity ids of v1 intersected with those of v2 as multisets (min multiplicity)."""
    return _side(results, v1).select("entity_id").intersectAll(_side(results, v2).select("entity_id"))


def _v2_summary(results: DataFrame, in2: Column | None = None, *more: Column) -> DataFrame:
    """One row per entity: everything the three "exists" tests need from its v2 results (those ``in2``, or all), and ``more``."""
    of2 = (lambda c: c) if in2 is None else (lambda c: F.when(in2, c))
    errs, success, runtime = of2(error_id_set("errors")), of2(F.col("success")), of2(F.col("runtime"))
    return results.groupBy("entity_id").agg(
        F.bool_or(success).alias("b_any_success"),
        F.bool_or(~success).alias("b_any_failure"),
        F.min(runtime).alias("b_min_rt"),
        F.max(runtime).alias("b_max_rt"),
        F.min(errs).alias("b_min_errs"),
        F.max(errs).alias("b_max_errs"),
        *more,
    )


def _differs(time_factor: float) -> tuple[Column, Column, Column]:
    """Whether a v1 result (success, runtime, a_errs) differs from some v2 result of its entity (:func:`_v2_summary`)."""
    k = F.lit(float(time_factor))
    return (
        F.when(F.col("success"), F.col("b_any_failure")).otherwise(F.col("b_any_success")),
        (F.col("runtime") <= F.col("b_max_rt") / k) | (F.col("runtime") >= F.col("b_min_rt") * k),
        (F.col("b_min_errs") != F.col("b_max_errs")) | (F.col("a_errs") != F.col("b_min_errs")),
    )


def version_diffs(results: DataFrame, v1: str, v2: str, time_factor: float = DEFAULT_TIME_FACTOR,
                  distinct: bool = False) -> DataFrame:
    """J6 in long form: ``(kind, entity_id, result_id)``, one row per v1 result that differs from some v2
    result of the same entity; kinds ``success``, ``runtime`` (C15), ``errors``. An entity with several v1
    results is listed once per result (Q2); ``distinct=True`` gives ``(kind, entity_id)`` once each."""
    # the inner join below keeps exactly the entities that have both versions
    a, b = _side(results, v1), _side(results, v2)
    s = _v2_summary(b)
    a_errs = error_id_set("errors")
    joined = a.select("entity_id", "result_id", "success", "runtime", a_errs.alias("a_errs")).join(s, "entity_id")
    success_diff, runtime_diff, error_diff = _differs(time_factor)
    tagged = joined.select(
        "entity_id",
        "result_id",
        F.array(
            F.when(success_diff, F.lit("success")),
            F.when(runtime_diff, F.lit("runtime")),
            F.when(error_diff, F.lit("errors")),
        ).alias("kinds"),
    )
    out = tagged.select(F.explode(F.array_compact("kinds")).alias("kind"), "entity_id", "result_id")
    return out.select("kind", "entity_id").distinct() if distinct else out


def version_diff_summary(results: DataFrame, v1: str, v2: str, time_factor: float = DEFAULT_TIME_FACTOR) -> DataFrame:
    """One row ``(v1, v2, n_shared, n_success_diff, n_runtime_diff, n_error_diff, avg_runtime1,
    avg_runtime2, var_runtime1, var_runtime2)``.

    Means are ``sum div count`` (truncated, Q1); variances are around that truncated mean and truncated,
    computed in exact decimal arithmetic. Empty sides give 0.
    """
    dec = "decimal(38,0)"
    in1, in2 = F.col("version_hash") == F.lit(v1), F.col("version_hash") == F.lit(v2)
    both = results.where(in1 | in2)
    # one row for each entity, written once: it answers for the shared entities and meets the rows again
    per_entity = cut_lineage(_v2_summary(both, in2, F.count_if(in1).alias("n1"), F.count_if(in2).alias("n2")).where("n1 > 0 AND n2 > 0"))
    rows = both.select("entity_id", "success", F.col("runtime"), error_id_set("errors").alias("a_errs"), in1.alias("in1"), in2.alias("in2"))
    rt = F.col("runtime").cast(dec)
    # one pass: n, sum x, sum x^2 of each side; then sum (x - m)^2 = Sxx - 2 m Sx + n m^2 with m = Sx div n (exact)
    sums = rows.join(per_entity, "entity_id").agg(
        *[F.count_if(F.col("in1") & d).alias(f"n_{kind}_diff") for kind, d in zip(("success", "runtime", "error"), _differs(time_factor), strict=True)],
        *[x for i in (1, 2) for x in (F.count_if(f"in{i}").alias(f"n{i}"), F.sum(F.when(F.col(f"in{i}"), rt)).alias(f"sx{i}"),
                                      F.sum(F.when(F.col(f"in{i}"), rt * rt)).alias(f"sxx{i}"))],
    )
    for i in (1, 2):
        n, sx, sxx, m = (F.col(f"{c}{i}") for c in ("n", "sx", "sxx", "avg_runtime"))
        # ``div`` truncates; a decimal ``/`` keeps six digits and may round up to the next whole number
        sums = sums.withColumn(f"avg_runtime{i}", F.when(n > 0, F.expr(f"sx{i} div n{i}")).otherwise(F.lit(0)).cast(dec))
        sums = sums.withColumn(f"ss{i}", (sxx - F.lit(2) * m * sx + n * m * m).cast(dec))
        sums = sums.withColumn(f"var_runtime{i}", F.when(n > 0, F.expr(f"ss{i} div n{i}")).otherwise(F.lit(0)))
    shared = per_entity.agg(F.coalesce(F.sum(F.least("n1", "n2")), F.lit(0)).alias("n_shared"))
    cols = ["n_shared", "n_success_diff", "n_runtime_diff", "n_error_diff", "avg_runtime1", "avg_runtime2", "var_runtime1", "var_runtime2"]
    # two rows, folded into one (no cross join)
    stacked = shared.unionByName(sums.select(*cols[1:]), allowMissingColumns=True)
    return stacked.select(F.lit(v1).alias("v1"), F.lit(v2).alias("v2"), *[F.max(c).cast("bigint").alias(c) for c in cols])

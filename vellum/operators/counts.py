"""Counts and summary statistics.

Each is a single hash aggregate (partial aggregation map-side, one small shuffle), or a global
aggregate whose partial results are a handful of rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.joins import semi_join_ids


def table_counts(**tables: DataFrame) -> DataFrame:
    """A1: one row per table name with its row count (``count(*)``); global aggregates, no shuffle of rows."""
    parts = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_entity_count(results: DataFrame) -> DataFrame:
    """A2: number of distinct entities with a result (exact)."""
    return results.select(F.count_distinct("entity_id").alias("n_entities"))


def approx_distinct_entity_count(results: DataFrame, rsd: float = 0.05) -> DataFrame:
    """A2, approximate variant (HyperLogLog++; constant memory per task)."""
    return results.select(F.approx_count_distinct("entity_id", rsd).alias("n_entities"))


def filtered_counts(df: DataFrame, **predicates: Column) -> DataFrame:
    """A3/A4: several ``count_if`` in one pass; one output column per named predicate."""
    return df.select(*[F.count_if(p).cast("bigint").alias(name) for name, p in predicates.items()])


def between(col: str, lo, hi) -> Column:
    """Inclusive range predicate used by A4."""
    return F.col(col).between(F.lit(lo), F.lit(hi))


def frontend_count_by_ids(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """A5: per frontend, how many of the given (de-duplicated) ids it has."""
    keys = ids.select(F.col(ids.columns[0]).alias("entity_id")).distinct()
    return semi_join_ids(entities, keys, "entity_id").groupBy("frontend").agg(F.count(F.lit(1)).alias("n"))


def feature_count(feature_entries: DataFrame, feature_name: str, include_const: bool = False) -> DataFrame:
    """Entries of a feature in back end A plus back end B; constants are not counted
    (reference behaviour) unless ``include_const``."""
    kinds = ["symbolic", "vcgen"] + (["const"] if include_const else [])
    return feature_entries.where(
        (F.col("feature_name") == F.lit(feature_name)) & F.col("ref_kind").isin(kinds)
    ).select(F.lit(feature_name).alias("feature_name"), F.count(F.lit(1)).alias("n"))


def mean_stdev_by(df: DataFrame, group: str | list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation (n - 1) per group."""
    return df.groupBy(group).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.count(F.lit(1)).alias("n")
    )


def mean_of(df: DataFrame, value: str, alias: str = "mean") -> DataFrame:
    """A10: mean of a column over the whole frame."""
    return df.select(F.avg(value).alias(alias))


def any_true(df: DataFrame, predicate: Column, group: str | list[str] | None = None) -> DataFrame:
    """A14: "some row satisfies" (``bool_or``), per group or overall."""
    if group is None:
        return df.select(F.coalesce(F.bool_or(predicate), F.lit(False)).alias("any_true"))
    return df.groupBy(group).agg(F.bool_or(predicate).alias("any_true"))

"""Ordered-sequence operators that stay correct and balanced when one key holds a large share of rows.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task. Here the rows are instead
range-partitioned on ``(key, order...)``, so a hot key spans several consecutive partitions; windows run over one
partition's rows of a key, and values that cross a partition boundary come from a table with one row per partition (its
size is bounded by the partition count, so broadcasting it is safe).

Used for: previous-row differences (W3) and dense sequential ids over a total order (S6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut_lineage


def _ranged(df: DataFrame, order: Sequence[str], n_parts: int | None) -> DataFrame:
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Fix partition contents once: both passes below must see the same rows in the same partitions.
    return cut_lineage(ranged).withColumn("_pid", F.spark_partition_id())


def gap_to_previous(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str = "gap", n_parts: int | None = None
) -> DataFrame:
    """``value - lag(value)`` within ``key`` ordered by ``order``; 0 for the first row of a key.

    Equals ``value - coalesce(lag(value) over (partition by key order by order), value)``, in the type of ``value``
    (whole numbers stay exact); rows with a null key are one group, as in a window.
    """
    ranged = _ranged(df, [key, *order], n_parts)
    inside = Window.partitionBy("_pid", key).orderBy(*order)
    local = ranged.withColumn("_prev", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))
    # Last row of every non-empty partition, and for each partition the last row of the one before it.
    ends = ranged.groupBy("_pid").agg(F.max(F.struct(*[F.col(c) for c in [key, *order]], F.col(value).alias("_v"))).alias("_e"))
    w = Window.orderBy("_pid")
    bounds = ends.select("_pid", F.lag(F.col(f"_e.{key}")).over(w).alias("_bkey"), F.lag(F.col("_e._v")).over(w).alias("_bval"),
                         F.lag(F.lit(True)).over(w).alias("_has"))
    fixed = local.join(F.broadcast(bounds), "_pid", "left")
    over = (F.col("_n") == 1) & F.col("_has") & F.col(key).eqNullSafe(F.col("_bkey"))
    prev = F.when(over, F.col("_bval")).otherwise(F.col("_prev"))
    gap = F.col(value) - F.coalesce(prev, F.col(value))
    return fixed.withColumn(out, gap.cast(df.schema[value].dataType)).select(*df.columns, out)


def dense_ids(df: DataFrame, order: Sequence[str], start: int = 1, out: str = "id", n_parts: int | None = None) -> DataFrame:
    """Dense ids ``start, start+1, ...`` following the total order ``order`` (deterministic, no single-task window).

    Each partition numbers its rows; offsets come from per-partition counts (one row per partition).
    """
    ranged = _ranged(df, order, n_parts)
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    return local.join(F.broadcast(offsets), "_pid", "left").select(
        *df.columns, (F.col("_off") + F.col("_local") + F.lit(start)).cast("bigint").alias(out))

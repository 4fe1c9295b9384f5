"""Look-ups, metadata filters, latest/oldest rows and set operations.

All functions take DataFrames in the logical schemas (see ``vellum.sources.tables``) and return
lazy DataFrames; filters are plain column predicates so Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.joins import semi_join_ids


def by_id(entities: DataFrame, entity_id: int, id_col: str = "entity_id") -> DataFrame:
    """F1 point look-up: zero or one row."""
    return entities.where(F.col(id_col) == F.lit(entity_id)).limit(1)


def by_ids(df: DataFrame, ids: DataFrame | Iterable[int], id_col: str = "entity_id") -> DataFrame:
    """F2 id-set look-up; the id list is de-duplicated first so each matching row is returned once.

    A Python list becomes an ``isin`` predicate (pushed into the scan); a DataFrame of ids becomes a left
    semi join (broadcast only by Spark's own size checks, see :func:`semi_join_ids`).
    """
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
        return semi_join_ids(df, keys, id_col)
    uniq = sorted({int(i) for i in ids})
    return df.where(F.col(id_col).isin(uniq))


def metadata_filter(
    entities: DataFrame,
    earliest=None,
    latest=None,
    min_loc: int | None = None,
    max_loc: int | None = None,
    frontend: str | None = None,
    verifier: str | None = None,
    parse_success: bool | None = None,
) -> DataFrame:
    """F3 + F15: all ranges inclusive; an absent option means no filter on that column.

    Predicates are combined cheapest first (plain column equalities, which also reach the parquet scan, then
    date bounds, then the line count, which is computed from the text): Spark evaluates a conjunction left to
    right, so rows failing a cheap test never pay for the expensive ones.
    """
    conds: list[Column] = []
    if frontend is not None:
        conds.append(F.col("frontend") == F.lit(frontend))
    if verifier is not None:
        conds.append(F.col("original_verifier") == F.lit(verifier))
    if earliest is not None:
        conds.append(F.col("submission_date") >= F.lit(earliest).cast("timestamp_ntz"))
    if latest is not None:
        conds.append(F.col("submission_date") <= F.lit(latest).cast("timestamp_ntz"))
    if min_loc is not None:
        conds.append(F.col("loc") >= F.lit(min_loc))
    if max_loc is not None:
        conds.append(F.col("loc") <= F.lit(max_loc))
    if parse_success is not None:
        conds.append(F.col("parse_success") == F.lit(parse_success))
    if not conds:
        return entities
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    return entities.where(cond)


def results_for_entity(results: DataFrame, entity_id: int) -> DataFrame:
    """F4."""
    return results.where(F.col("entity_id") == F.lit(entity_id))


def results_for_version(results: DataFrame, version_hash: str) -> DataFrame:
    """F5."""
    return results.where(F.col("version_hash") == F.lit(version_hash))


def entity_ids_by_result_data(
    results: DataFrame,
    success: bool | None = None,
    did_timeout: bool | None = None,
    min_runtime: int | None = None,
    max_runtime: int | None = None,
) -> DataFrame:
    """distinct entity ids of results with the given outcome and an inclusive runtime range."""
    out = results
    if success is not None:
        out = out.where(F.col("success") == F.lit(success))
    if did_timeout is not None:
        out = out.where(F.col("did_timeout") == F.lit(did_timeout))
    if min_runtime is not None:
        out = out.where(F.col("runtime") >= F.lit(min_runtime))
    if max_runtime is not None:
        out = out.where(F.col("runtime") <= F.lit(max_runtime))
    return out.select("entity_id").distinct()


def ids_of(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """the id list of an answer."""
    return df.select(id_col)


def find_term(entities: DataFrame, term: str) -> DataFrame:
    """F8: ids whose text contains ``term`` (plain substring)."""
    return entities.where(F.col("program").contains(F.lit(term))).select("entity_id")


def latest_per_entity(results: DataFrame) -> DataFrame:
    """Latest result of every entity (creation date desc, result id desc as tie-break).

    Expressed as ``max(struct(date, id, ...))`` per entity: an aggregate with a partial (map-side) step,
    so an entity holding a third of all results never lands whole in one task.
    """
    others = [c for c in results.columns if c not in ("entity_id", "creation_date", "result_id")]
    packed = F.struct(F.col("creation_date"), F.col("result_id"), *[F.col(c) for c in others])
    return (
        results.groupBy("entity_id")
        .agg(F.max(packed).alias("r"))
        .select("entity_id", "r.creation_date", "r.result_id", *[f"r.{c}" for c in others])
    )


def oldest(queue: DataFrame, date_col: str = "submission_date", id_col: str = "submission_id") -> DataFrame:
    """Oldest queued row (date asc, id asc); plans as a distributed top-1 (TakeOrderedAndProject)."""
    return queue.orderBy(F.col(date_col).asc(), F.col(id_col).asc()).limit(1)


def first_row(df: DataFrame, order_by: str | list[str]) -> DataFrame:
    """First row; an order is added so the answer is deterministic (distributed top-1)."""
    return df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(1)


def multiset_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset intersection (each value min(count_a, count_b) times)."""
    return a.intersectAll(b)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: set union."""
    return a.unionByName(b).distinct()


def print_candidates(probes: DataFrame, entities: DataFrame, keys: list[str], band: tuple[float, float]) -> DataFrame:
    """``(probe_id, entity_id)``: stored entities of equal ``keys`` whose ``loc`` is in a probe's size band
    ``[int(lo * loc), int(hi * loc)]``, the probe itself apart. Results play no part.

    Both sides carry a size class, floor(log2 loc); the probe its own and both neighbours (all that a band up to a factor of two
    can hold), so the join key splits a hot set of keys by size.
    """
    lo, hi = band
    if lo < 0.5 or hi > 2.0:
        raise ValueError("the size classes hold bands from 0.5 to 2 alone")
    size = F.when(F.col("loc") <= 0, F.lit(-1)).otherwise(F.floor(F.log2(F.col("loc").cast("double")))).cast("int")
    p = probes.select(F.col("entity_id").alias("probe_id"), F.col("loc").alias("p_loc"), *keys, size.alias("s"))
    p = p.select("probe_id", "p_loc", *keys, F.explode(F.sequence(F.col("s") - 1, F.col("s") + 1)).alias("s"))
    e = entities.select("entity_id", "loc", *keys, size.alias("s"))
    j = p.join(e, [*keys, "s"]).where("entity_id <> probe_id")
    return j.where(F.col("loc").between((F.col("p_loc") * F.lit(lo)).cast("int"), (F.col("p_loc") * F.lit(hi)).cast("int"))).select("probe_id", "entity_id")

"""Table maintenance without a database (S5-S13, S18): appends, generated keys, upserts, deletes,
cascades, snapshots and integrity checks.

Tables are parquet directories; every change writes a new snapshot directory instead of mutating files,
so a failed job leaves the previous snapshot intact and a retried job rewrites the same output.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.sequences import dense_ids
from vellum.session import checkpoint_dir, cut_lineage


def max_id(existing: DataFrame, id_col: str):
    """The largest id (0 for an empty table) as a scalar-subquery column: evaluated once, no join."""
    return existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()


def with_new_ids(existing: DataFrame, new: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids for new rows = max(existing id) + 1, 2, ... following the total order ``order``.

    Deterministic and dense (unlike ``monotonically_increasing_id``); no single-task window (see
    :func:`vellum.operators.sequences.dense_ids`). The max is a scalar subquery.
    """
    numbered = dense_ids(new, order, start=1, out="_seq")
    return numbered.select(*new.columns, (max_id(existing, id_col) + F.col("_seq")).cast("bigint").alias(id_col))


def propagate_keys(parent: DataFrame, children: dict[str, DataFrame], temp_key: str, id_col: str) -> dict[str, DataFrame]:
    """A batch of parents carries a temporary key; once parent ids are assigned (S6) every child table
    gets the real id through one join on the temporary key. Returns the children with ``id_col`` added."""
    keymap = parent.select(temp_key, id_col)
    return {name: ch.join(keymap, temp_key).drop(temp_key) for name, ch in children.items()}


# --- S7: a batch of entities with all that hangs on them, seen whole or not at all ----------------------------------------

BATCH_TABLES = ("entities", "prints", "results_a", "results_b", "features")


def committed(spark: SparkSession, root: str) -> DataFrame | None:
    """The commits below ``root`` (commit, n_entities), None before the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(os.path.join(root, "commits"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The rows of a batch table that commits name; what a failed batch left behind is not among them."""
    commits = committed(spark, root)
    if commits is None:
        return None
    rows = spark.read.parquet(os.path.join(root, table))
    return rows.join(commits.select("commit"), "commit", "left_semi").drop("commit")


def insert_batch(spark: SparkSession, root: str, commit: int, entities: DataFrame, prints: DataFrame, results: dict[str, DataFrame],
                 temp_key: str) -> bool:
    """S7 in three levels: entities get ids (S6, in order of ``temp_key``), prints and the results of back ends ``a`` and ``b`` get
    them through ``temp_key``, results get ids of their own (by entity), and each result's ``features`` (a map) become rows
    that carry the result's id.

    Every table is written to a folder of the commit, and the commit's own row last, so readers see all of a batch or nothing. A
    commit that is there is not made again: False is returned and nothing changes. One that failed is made again over what
    it left.
    """
    done = committed(spark, root)
    if done is not None and not done.where(F.col("commit") == F.lit(commit)).isEmpty():
        return False

    def numbered(new: DataFrame, table: str, id_col: str, order: list[str]) -> DataFrame:
        old = read_committed(spark, root, table)
        old = spark.createDataFrame([], f"{id_col} long") if old is None else old.select(id_col)
        return cut_lineage(with_new_ids(old, new, id_col, order))

    ents = numbered(entities, "entities", "entity_id", [temp_key])
    below = propagate_keys(ents, {"prints": prints, **{f"results_{k}": r for k, r in results.items()}}, temp_key, "entity_id")
    tables = {"entities": ents, "prints": below["prints"]}
    feats = None
    for k in results:
        rows = numbered(below[f"results_{k}"], f"results_{k}", "result_id", ["entity_id"])
        tables[f"results_{k}"] = rows.drop("features")
        f = rows.select(F.lit(k).alias("ref_kind"), F.col("result_id").alias("ref_id"), F.explode("features").alias("feature_name", "value"))
        feats = f if feats is None else feats.unionByName(f)
    tables["features"] = feats
    for name in BATCH_TABLES:
        _write_part(tables[name], os.path.join(root, name, f"commit={commit}"))
    _write_part(ents.agg(F.count(F.lit(1)).alias("n_entities")), os.path.join(root, "commits", f"commit={commit}"))
    return True


def _write_part(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def upsert(existing: DataFrame, updates: DataFrame, key: str, id_col: str) -> DataFrame:
    """Replace rows whose ``key`` occurs in ``updates`` (keeping their surrogate ``id_col``); insert the
    rest of ``updates`` with new ids (S6, ordered by ``key``). Other rows stay unchanged. Of several updates with one
    key the greatest row (by its columns in order) holds; a null key matches nothing and is inserted."""
    others = [c for c in updates.columns if c != key]
    one = updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_r"))
    updates = one.select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*updates.columns).unionByName(
        updates.where(F.col(key).isNull()))
    kept_ids = existing.select(key, id_col)
    matched = updates.join(kept_ids, key, "inner")
    fresh = updates.join(kept_ids.select(key), key, "left_anti")
    fresh = with_new_ids(existing, fresh, id_col, [key])
    untouched = existing.join(updates.select(key), key, "left_anti")
    cols = existing.columns
    return untouched.select(*cols).unionByName(matched.select(*cols)).unionByName(fresh.select(*cols))


def delete_by_keys(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """``(remaining rows, one-row frame with the number deleted)``."""
    remaining = df.join(keys, on, "left_anti")
    deleted = df.join(keys, on, "left_semi").select(F.count(F.lit(1)).alias("n_deleted"))
    return remaining, deleted


def cascade_delete(
    tables: dict[str, DataFrame],
    foreign_keys: list[tuple[str, str, str, str]],
    root: str,
    root_keys: DataFrame,
    root_key_col: str,
) -> dict[str, DataFrame]:
    """Delete ``root_keys`` from ``root`` and, following ``foreign_keys`` (child, child_col, parent,
    parent_col), every row that references a deleted row, transitively. Returns the remaining tables.

    The FK graph is walked on the driver (it is schema, not data). A table is settled after every table it refers to
    (parents first), so each edge is followed once with all rows that went before it; tables that refer to each other
    in a circle, or to themselves, are repeated together until no further row goes. Every step is a semi or anti join.
    """
    keys = root_keys.select(root_key_col).distinct()
    gone: dict[str, DataFrame] = {}
    out = dict(tables)

    def settle(name: str) -> None:
        """Splits a table by the rows that went so far: each edge takes its rows from what the others left."""
        rest, went = tables[name], None
        cuts = [(root_key_col, keys)] if name == root else []
        cuts += [(ccol, gone[parent].select(F.col(pcol).alias(ccol)).distinct())
                 for child, ccol, parent, pcol in foreign_keys if child == name and parent in gone]
        for col, k in cuts:
            part = rest.join(k, col, "left_semi")
            went = part if went is None else went.unionByName(part)
            rest = rest.join(k, col, "left_anti")
        if went is not None:
            gone[name], out[name] = went.select(*tables[name].columns), rest.select(*tables[name].columns)

    for group in _parents_first(foreign_keys, root):
        if len(group) == 1 and not any(c == p == group[0] for c, _, p, _ in foreign_keys):
            settle(group[0])
            continue
        before = -1
        while (now := sum(gone[t].count() for t in group if t in gone)) > before:
            before = now
            for t in group:
                settle(t)
                if t in gone:
                    gone[t] = cut_lineage(gone[t])
    return out


def _parents_first(foreign_keys: list[tuple[str, str, str, str]], root: str) -> list[list[str]]:
    """Tables that depend on ``root``, in groups that refer to each other in a circle, parents before children."""
    children: dict[str, set[str]] = {}
    for c, _, p, _ in foreign_keys:
        children.setdefault(p, set()).add(c)

    def below(t: str) -> set[str]:
        seen, todo = set(), [t]
        while todo:
            for c in children.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    reach = {t: below(t) for t in {root} | below(root)}
    groups: list[list[str]] = []
    for t in sorted(reach):
        if not any(t in g for g in groups):
            groups.append([t, *sorted(u for u in reach if u != t and u in reach[t] and t in reach[u])])
    # a group comes after every group that reaches it
    out: list[list[str]] = []
    while groups:
        free = next(g for g in groups if not any(g[0] in reach[o[0]] for o in groups if o is not g))
        out.append(free)
        groups.remove(free)
    return out


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], base_dir: str | None = None, tag: str | None = None) -> str:
    """Write every table to ``<base>/<tag>/<name>`` (parquet); returns the snapshot directory.

    The default base is ``<spark.checkpoint.dir>/snapshots`` (a shared folder on a cluster).
    """
    base = base_dir or os.path.join(checkpoint_dir(spark), "snapshots")
    tag = tag or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    root = os.path.join(base, tag)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(root, name))
    return root


def restore(spark: SparkSession, snapshot_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Read a snapshot back."""
    return {n: spark.read.parquet(os.path.join(snapshot_dir, n)) for n in names}


def integrity_report(
    tables: dict[str, DataFrame],
    primary_keys: dict[str, list[str]],
    foreign_keys: list[tuple[str, str, str, str]],
    extra_tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per check ``(check_name, n_violations)``: NOT NULL per column of ``tables``, PK uniqueness
    (keys held by more than one row), FK presence (orphan rows). ``extra_tables`` are only FK targets."""
    all_tables = {**tables, **(extra_tables or {})}
    parts: list[DataFrame] = []
    for name, df in tables.items():
        parts.append(
            df.select(
                F.explode(
                    F.array(*[F.struct(F.lit(f"not_null:{name}.{c}").alias("check_name"),
                                       F.count_if(F.col(c).isNull()).cast("bigint").alias("n_violations"))
                              for c in df.columns])
                ).alias("r")
            ).select("r.*")
        )
    for name, cols in primary_keys.items():
        dup = tables[name].groupBy(*cols).count().where("count > 1")
        parts.append(dup.select(F.lit(f"primary_key:{name}").alias("check_name"),
                                F.count(F.lit(1)).cast("bigint").alias("n_violations")))
    for child, ccol, parent, pcol in foreign_keys:
        orphans = all_tables[child].join(all_tables[parent].select(F.col(pcol).alias(ccol)), ccol, "left_anti")
        parts.append(orphans.select(F.lit(f"foreign_key:{child}.{ccol}->{parent}.{pcol}").alias("check_name"),
                                    F.count(F.lit(1)).cast("bigint").alias("n_violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Registered queries, part 4: table maintenance (S*), admission (K*), evaluator (U-1), JSON."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.operators import maintenance as M
from vellum.operators.fingerprint import document_prints
from vellum.plans.catalog_similarity import (
    BAND,
    DIRECT_SQL,
    ENTITY_IDS,
    SAME_KEYS_IN_BAND,
    admission_sql,
    doc_prints,
    entity_prints,
)
from vellum.plans.oracle_views import ENTITIES, SUBMISSIONS, prints_ctes, with_
from vellum.plans.registry import query
from vellum.session import checkpoint_dir
from vellum.sources import tables as T
from vellum.streaming import admission as K


KEYS = ["frontend", "original_verifier", "parse_success"]


@query(
    "S6_append_with_ids",
    "SELECT event_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, event_id) AS result_id "
    "FROM events",
)
def q_s6(spark, sf_dir):
    existing = T.results_symbolic(spark, sf_dir).select("result_id")
    new = T.read(spark, sf_dir, "events").select("event_id", "ts")
    return M.with_new_ids(existing, new, "result_id", ["ts", "event_id"]).select("event_id", "result_id")


@query(
    "S7_propagate_keys",
    """WITH ids AS (SELECT item_id, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY item_id) AS entity_id
             FROM benchmark)
SELECT ids.entity_id, 'hasSeq' AS feature_name, CAST(regexp_matches(b.text, '(?m)^.*Seq\\[.*\\].*$') AS VARCHAR) AS value
FROM benchmark b JOIN ids USING (item_id)""",
)
def q_s7(spark, sf_dir):
    """A batch of submissions (benchmark) becomes entities with fresh ids; their feature rows, built before the
    ids exist, receive the ids through the temporary key."""
    from vellum.operators.features import SYNTAX_FEATURES
    from vellum.operators.search import matches_at_least_one
    from vellum.functions.regex import FLAG_MULTILINE

    b = T.read(spark, sf_dir, "benchmark")
    ents = M.with_new_ids(T.entities(spark, sf_dir).select("entity_id"), b.select("item_id"), "entity_id", ["item_id"])
    pats = dict(SYNTAX_FEATURES)["hasSeq"]
    feats = b.select("item_id", F.lit("hasSeq").alias("feature_name"),
                     matches_at_least_one(F.col("text"), pats, FLAG_MULTILINE).cast("string").alias("value"))
    return M.propagate_keys(ents, {"features": feats}, "item_id", "entity_id")["features"].select(
        "entity_id", "feature_name", "value"
    )


_BATCHES = """b AS (SELECT doc_id, doc_id % 3 AS batch, lang, n_chars FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT *, row_number() OVER (ORDER BY batch, doc_id) AS entity_id FROM b),
ra AS (SELECT *, row_number() OVER (ORDER BY batch, entity_id) AS result_id FROM e),
rb AS (SELECT *, row_number() OVER (ORDER BY batch, entity_id) AS result_id FROM e WHERE n_chars % 2 = 0)"""


@query(
    "S7_three_levels",
    "WITH " + _BATCHES + """
SELECT 'entities' AS part, entity_id AS id, doc_id AS ref, lang AS name, '' AS value FROM e
UNION ALL SELECT 'prints', entity_id, n_chars, '', '' FROM e
UNION ALL SELECT 'results_a', result_id, entity_id, '', CAST(n_chars % 3 = 0 AS VARCHAR) FROM ra
UNION ALL SELECT 'results_b', result_id, entity_id, '', CAST(n_chars % 5 = 0 AS VARCHAR) FROM rb
UNION ALL SELECT 'features', result_id, 0, 'a:chars', CAST(n_chars AS VARCHAR) FROM ra
UNION ALL SELECT 'features', result_id, 0, 'b:lang', lang FROM rb""",
)
def q_s7_levels(spark, sf_dir):
    """The documents as three batches: entities, prints, results of two back ends and their features, each batch committed
    whole; then the committed tables, one below the other."""
    root = os.path.join(checkpoint_dir(spark), f"batches-{uuid.uuid4().hex}")
    d = T.read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    for k in range(3):
        b = d.where(F.col("doc_id") % 3 == k)
        res = {"a": b.select("doc_id", (F.col("n_chars") % 3 == 0).alias("success"), F.create_map(F.lit("chars"), F.col("n_chars").cast("string")).alias("features")),
               "b": b.where("n_chars % 2 = 0").select("doc_id", (F.col("n_chars") % 5 == 0).alias("success"), F.create_map(F.lit("lang"), F.col("lang")).alias("features"))}
        M.insert_batch(spark, root, k, b.select("doc_id", "lang"), b.select("doc_id", F.col("n_chars").alias("print")), res, "doc_id")
    read = lambda name: M.read_committed(spark, root, name)
    row = lambda df, part, id_, ref, name, value: df.select(
        F.lit(part).alias("part"), F.col(id_).alias("id"), ref.cast("bigint").alias("ref"), name.alias("name"), value.alias("value"))
    empty, ok = F.lit(""), F.col("success").cast("string")
    out = row(read("entities"), "entities", "entity_id", F.col("doc_id"), F.col("lang"), empty)
    out = out.unionByName(row(read("prints"), "prints", "entity_id", F.col("print"), empty, empty))
    for k in ("results_a", "results_b"):
        out = out.unionByName(row(read(k), k, "result_id", F.col("entity_id"), empty, ok))
    return out.unionByName(row(read("features"), "features", "ref_id", F.lit(0), F.concat_ws(":", "ref_kind", "feature_name"), F.col("value")))


@query(
    "S9_upsert",
    """WITH existing AS (SELECT doc_id * 10 AS print_id, doc_id AS entity_id, CAST(quality AS BIGINT) AS value FROM labels),
updates AS (SELECT doc_id AS entity_id, n_chars AS value FROM documents)
SELECT print_id, entity_id, value FROM existing WHERE entity_id NOT IN (SELECT entity_id FROM updates)
UNION ALL
SELECT e.print_id, u.entity_id, u.value FROM updates u JOIN existing e USING (entity_id)
UNION ALL
SELECT (SELECT max(print_id) FROM existing) + row_number() OVER (ORDER BY entity_id), entity_id, value
FROM updates WHERE entity_id NOT IN (SELECT entity_id FROM existing)""",
)
def q_s9(spark, sf_dir):
    lb = T.read(spark, sf_dir, "labels")
    existing = lb.select((F.col("doc_id") * 10).alias("print_id"), F.col("doc_id").alias("entity_id"),
                         F.col("quality").cast("bigint").alias("value"))
    updates = T.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entity_id"), F.col("n_chars").alias("value")
    )
    return M.upsert(existing, updates, "entity_id", "print_id")


@query(
    "S10_delete_by_key",
    """SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'))
  AS n_deleted,
  (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'))
  AS n_remaining""",
)
def q_s10(spark, sf_dir):
    orders = T.read(spark, sf_dir, "orders")
    keys = T.read(spark, sf_dir, "customer").where("c_mktsegment = 'AUTOMOBILE'").select(F.col("c_custkey").alias("o_custkey"))
    remaining, deleted = M.delete_by_keys(orders, keys, "o_custkey")
    st = deleted.unionByName(remaining.select(F.count(F.lit(1)).alias("n_remaining")), allowMissingColumns=True)
    return st.select(F.max("n_deleted").alias("n_deleted"), F.max("n_remaining").alias("n_remaining"))


_FKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]


@query(
    "S12_cascade_delete",
    """WITH gone_c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 5),
gone_o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone_c))
SELECT 'customer' AS table_name, count(*) AS n_remaining FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone_c)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone_o)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_o)""",
)
def q_s12(spark, sf_dir):
    tabs = {n: T.read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    keys = tabs["customer"].where("c_nationkey = 5").select("c_custkey")
    rem = M.cascade_delete(tabs, _FKS, "customer", keys, "c_custkey")
    parts = [rem[n].select(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_remaining")) for n in tabs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "S13_snapshot_roundtrip",
    "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in T.TABLES),
)
def q_s13(spark, sf_dir):
    tabs = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in T.TABLES}
    snap = M.snapshot(spark, tabs, tag=f"roundtrip-{uuid.uuid4().hex}")
    back = M.restore(spark, snap, list(tabs))
    parts = [df.select(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, df in back.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
}


@query(
    "S18_integrity",
    "\nUNION ALL ".join(f"SELECT 'not_null:{t}.{c}' AS check_name, count(*) FILTER (WHERE {c} IS NULL) AS n_violations FROM {t}"
                        for t, cols in _COLUMNS.items() for c in cols)
    + """
UNION ALL SELECT 'primary_key:orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'primary_key:customer', count(*) FROM (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(*) > 1)
UNION ALL SELECT 'primary_key:lineitem', count(*) FROM
  (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'foreign_key:lineitem.l_orderkey->orders.o_orderkey', count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'foreign_key:orders.o_custkey->customer.c_custkey', count(*) FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'foreign_key:orders.o_custkey->labels.doc_id', count(*) FROM orders
  WHERE o_custkey NOT IN (SELECT doc_id FROM labels)""",
)
def q_s18(spark, sf_dir):
    """The last check has violations: not every customer number is a labelled document."""
    tabs = {t: T.read(spark, sf_dir, t).select(*cols) for t, cols in _COLUMNS.items()}
    return M.integrity_report(
        tabs,
        {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]},
        [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
         ("orders", "o_custkey", "labels", "doc_id")],
        extra_tables={"labels": T.read(spark, sf_dir, "labels").select("doc_id")},
    )


@query(
    "K1_accept_submissions",
    with_(SUBMISSIONS) + "SELECT submission_id, loc, TIMESTAMP '2025-06-01 00:00:00' AS submission_date FROM submissions",
)
def q_k1(spark, sf_dir):
    raw = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("submission_id"), F.col("text").alias("program"))
    out = K.accept_submissions(raw, stamp=F.lit("2025-06-01 00:00:00").cast("timestamp_ntz"))
    return out.select("submission_id", "loc", "submission_date")


@query(
    "K2_queue_to_entities",
    "SELECT event_id AS submission_id, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY ts, event_id) "
    "AS entity_id FROM events",
)
def q_k2(spark, sf_dir):
    q = T.event_queue(spark, sf_dir).select("submission_id", "submission_date")
    existing = T.entities(spark, sf_dir).select("entity_id")
    return K.queue_to_entities(q, existing).select("submission_id", "entity_id")


@query("K3_sequential_admission", admission_sql(prints_ctes(), ENTITY_IDS, SAME_KEYS_IN_BAND, DIRECT_SQL, ENTITIES + ",\n"))
def q_k3(spark, sf_dir):
    """Total percentages for items straight from a verifier, method and function sections for generated ones."""
    return K.admit(entity_prints(spark, sf_dir), None, block=KEYS, band=BAND, direct="direct")


@query("K4_store_only_admission", admission_sql(prints_ctes(), ENTITY_IDS, SAME_KEYS_IN_BAND, "TRUE", ENTITIES + ",\n"))
def q_k4(spark, sf_dir):
    """Prints alone decide, among items of equal verifier, front end and parse flag in the size band."""
    return K.admit(entity_prints(spark, sf_dir), None, block=KEYS, band=BAND)


@query("K4_unblocked_admission", admission_sql(prints_ctes(), "SELECT doc_id FROM prints"))
def q_k4u(spark, sf_dir):
    """Without blocking keys and band: any two documents may be similar."""
    return K.admit(doc_prints(spark, sf_dir), None)


STREAM_FILES, FILE_ROWS = 4, 100_000  # the stream's input has at least so many files, and one for so many rows
ROW_GROUP = 16 << 20  # bytes of a row group of these files


def write_submissions(docs: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Submissions as files in order of ids: one write a file, so that the files' times follow the ids. The files grow with the
    rows, not the rows of a file; null and negative ids stand in the first. Row groups are small: several tasks read a file."""
    n = max(STREAM_FILES, -(-docs.count() // file_rows))
    cuts = sorted(set(docs.where("submission_id IS NOT NULL").approxQuantile("submission_id", [k / n for k in range(1, n)], 0.1 / n)))
    above = F.lit(0)
    for c in cuts:
        above = above + F.when(F.col("submission_id") > F.lit(int(c)), 1).otherwise(0)
    staged = f"{folder}-staged"
    part = F.when(F.col("submission_id") >= 0, above).otherwise(0)
    docs.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(staged)
    rows = docs.sparkSession.read.parquet(staged)
    for k in range(len(cuts) + 1):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(folder)


@query("K7_stream_admission", admission_sql(prints_ctes(), "SELECT doc_id FROM prints"),
       note="Structured Streaming; the batches' decisions together are the one-by-one admission")
def q_k7(spark, sf_dir):
    """Runs the streaming admission job (availableNow) over the documents as submission files in order of ids, and returns
    the decisions it produced."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    subs = os.path.join(base, "submissions")
    docs = T.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("submission_id"), F.col("text").alias("program"),
        F.lit("Generic").alias("frontend"), F.lit("symbolic").alias("original_verifier"),
    )
    write_submissions(docs, subs)
    q = K.start_admission_stream(spark, subs, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                                 max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out", "decisions")).select("doc_id", "accepted")


@query(
    "U1_evaluate",
    with_(ENTITIES) + "SELECT entity_id, 'symbolic' AS backend, loc <= 50 AS success, FALSE AS did_timeout, "
    "CAST(length(program) AS BIGINT) AS runtime, []::VARCHAR[] AS error_ids FROM entities",
    note="user evaluator in Arrow batches",
)
def q_u1(spark, sf_dir):
    return _evaluated(spark, sf_dir).drop("features")


def _evaluated(spark, sf_dir):
    def line_budget_evaluator(entity: dict, args: list[str], timeout: int) -> dict:
        n = int(entity["loc"])
        return {"success": n <= 50, "did_timeout": False, "runtime": len(entity["program"]), "error_ids": [],
                "features": {"isLong": n > 10, "lines": n}}

    ents = T.entities(spark, sf_dir).select("entity_id", "program", "loc", "args")
    return K.evaluate(ents, line_budget_evaluator, "symbolic")


@query(
    "U1_feature_rows",
    with_(ENTITIES) + "SELECT 'isLong' AS feature_name, 'symbolic' AS ref_kind, entity_id AS ref_id, "
    "CASE WHEN loc > 10 THEN 'True' ELSE 'False' END AS value FROM entities "
    "UNION ALL SELECT 'lines', 'symbolic', entity_id, CAST(loc AS VARCHAR) FROM entities",
)
def q_u1f(spark, sf_dir):
    return K.evaluated_features(_evaluated(spark, sf_dir))


@query("P11_recreate_prints", "WITH " + prints_ctes() + "\nSELECT doc_id, root_hash, total FROM prints")
def q_p11(spark, sf_dir):
    out = os.path.join(checkpoint_dir(spark), f"prints-{uuid.uuid4().hex}")
    return K.recreate_prints(spark, T.read(spark, sf_dir, "documents"), out).select("doc_id", "root_hash", "total")


@query(
    "P12_prints_json",
    "WITH " + prints_ctes() + """,
ks AS (SELECT doc_id, li, list(h ORDER BY si) AS sents FROM kept_sents GROUP BY doc_id, li),
ls AS (SELECT k.doc_id, list({h: k.h, w: k.w, sents: coalesce(ks.sents, []::VARCHAR[])} ORDER BY k.li) AS lines
       FROM kept_lines k LEFT JOIN ks USING (doc_id, li) GROUP BY k.doc_id)
SELECT p.doc_id, CAST(to_json({root_hash: p.root_hash, weight: p.weight, total: p.total,
                               lines: coalesce(ls.lines, [])}) AS VARCHAR) AS json
FROM prints p LEFT JOIN ls USING (doc_id)""",
)
def q_p12(spark, sf_dir):
    p = document_prints(T.read(spark, sf_dir, "documents"))
    return p.select("doc_id", S.as_json("root_hash", "weight", "total", "lines").alias("json"))


@query(
    "C16_json_entries",
    with_(ENTITIES) + "SELECT entity_id, CAST(to_json({entity_id: entity_id, loc: loc, frontend: frontend, "
    "original_verifier: original_verifier}) AS VARCHAR) AS json FROM entities",
)
def q_c16(spark, sf_dir):
    e = T.entities(spark, sf_dir)
    return e.select("entity_id", S.as_json("entity_id", "loc", "frontend", "original_verifier").alias("json"))


def _strip_sql(flags) -> str:
    """DuckDB: the C4 fold as a chain of CTEs, one per flag (first occurrence; value dropped unless it is a flag)."""
    ctes = ["s0 AS (SELECT conv_id, turn, args AS a FROM a)"]
    for i, f in enumerate(flags, 1):
        ctes.append(
            f"""s{i} AS (SELECT conv_id, turn, CASE
  WHEN list_position(a, '{f}') IS NULL THEN a
  WHEN list_position(a, '{f}') < len(a) AND starts_with(a[list_position(a, '{f}') + 1], '--')
    THEN list_concat(a[1:list_position(a, '{f}') - 1], a[list_position(a, '{f}') + 1:])
  ELSE list_concat(a[1:list_position(a, '{f}') - 1], a[list_position(a, '{f}') + 2:]) END AS a FROM s{i - 1})"""
        )
    return ",\n".join(ctes) + f"\nSELECT conv_id, turn, CAST(len(a) AS INTEGER) AS n_args, md5(array_to_string(a, ' ')) AS args_md5 FROM s{len(flags)}"


_C4_ARGS_SQL = """WITH a AS (SELECT conv_id, turn,
  list_concat(['--timeout', CAST(turn AS VARCHAR), '--z3Exe', role],
              string_split(text, ' '), ['--printMethodCFGs', '--randomFlag', '--cvc5Exe', '--timeout']) AS args
  FROM conversations),
"""


@query("C4_strip_options", _C4_ARGS_SQL + _strip_sql(S.STRIP_FLAGS_SYMBOLIC))
def q_c4(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations")
    args = F.concat(
        F.array(F.lit("--timeout"), F.col("turn").cast("string"), F.lit("--z3Exe"), F.col("role")),
        F.split(F.col("text"), " ", -1),
        F.array(F.lit("--printMethodCFGs"), F.lit("--randomFlag"), F.lit("--cvc5Exe"), F.lit("--timeout")),
    )
    stripped = S.strip_options(args)
    return c.select("conv_id", "turn", F.size(stripped).cast("int").alias("n_args"),
                    F.md5(F.array_join(stripped, " ")).alias("args_md5"))

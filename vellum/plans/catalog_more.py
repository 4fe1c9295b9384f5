"""Registered queries, part 5: program sections, conjunctions, result-aware similarity, files, more scalars."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.operators import fingerprint as FP
from vellum.operators import programs as PG
from vellum.operators import similarity as SIM
from vellum.plans.catalog_similarity import (
    BAND,
    DIRECT_SQL,
    ENTITY_IDS,
    KEYS,
    SAME_KEYS_IN_BAND,
    admission_sql,
    entity_prints,
    j4_sql,
)
from vellum.plans.catalog_tables import _C4_ARGS_SQL, _strip_sql
from vellum.plans.oracle_views import (
    ENTITIES,
    ORDER_ERRORS,
    RESULTS_SYMBOLIC,
    RESULTS_SYMBOLIC_ERR,
    loc_sql,
    prints_ctes,
    with_,
)
from vellum.plans.registry import query
from vellum.session import checkpoint_dir, cut_lineage, is_spread
from vellum.sources import files as FS
from vellum.sources import tables as T
from vellum.streaming import admission as K

_SIG_CTES = """sig_sym AS (SELECT DISTINCT o_custkey AS entity_id, o_orderstatus = 'F' AS success,
                        coalesce(e.error_ids, []::VARCHAR[]) AS errs
          FROM orders o LEFT JOIN (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS error_ids
                                   FROM lineitem GROUP BY l_orderkey) e ON e.l_orderkey = o.o_orderkey),
sig_vcg AS (SELECT DISTINCT user_id AS entity_id, value <= 100 AS success FROM events)"""


_SAME_RESULTS = """EXISTS (SELECT 1 FROM sig_sym x JOIN sig_sym y ON x.success = y.success AND x.errs = y.errs
              WHERE x.entity_id = a_id AND y.entity_id = b_id)
  AND EXISTS (SELECT 1 FROM sig_vcg x JOIN sig_vcg y ON x.success = y.success
              WHERE x.entity_id = a_id AND y.entity_id = b_id)"""


def document_results(spark, sf_dir):
    """Results of both back ends for the documents, derived from them so that near copies often have equal outcomes."""
    d = T.entities(spark, sf_dir)
    err = F.when(F.col("loc") % 3 == 0, F.array(F.struct(F.col("original_verifier").alias("error_id"), F.lit("").alias("message"))))
    none = F.array().cast(T.ERROR_TYPE)
    a = d.select("entity_id", (F.col("loc") % 2 == 0).alias("success"), F.coalesce(err.cast(T.ERROR_TYPE), none).alias("errors"))
    b = d.where(F.col("entity_id") % 50 != 49).select("entity_id", (F.col("loc") % 5 != 0).alias("success"), none.alias("errors"))
    return a, b


_DOC_RESULTS = """res_a AS (SELECT entity_id, loc % 2 = 0 AS success, CASE WHEN loc % 3 = 0 THEN [original_verifier] ELSE [] END AS errs FROM entities),
res_b AS (SELECT entity_id, loc % 5 <> 0 AS success FROM entities WHERE entity_id % 50 <> 49),
"""


@query(
    "J4_with_results",
    j4_sql(
        agree="CASE WHEN rb.entity_id IS NULL THEN 'alone' || p.doc_id ELSE ra.success || '|' || ra.errs::VARCHAR || '|' || rb.success END",
        ctes=_DOC_RESULTS, joins="LEFT JOIN res_a ra ON ra.entity_id = p.doc_id LEFT JOIN res_b rb ON rb.entity_id = p.doc_id",
        keep="""EXISTS (SELECT 1 FROM res_a x JOIN res_a y ON x.success = y.success AND x.errs = y.errs
                 WHERE x.entity_id = matches.a_id AND y.entity_id = matches.b_id)
  AND EXISTS (SELECT 1 FROM res_b x JOIN res_b y ON x.success = y.success WHERE x.entity_id = matches.a_id AND y.entity_id = matches.b_id)"""),
)
def q_j4r(spark, sf_dir):
    """J4 + P10: print-similar candidate pairs whose results in both back ends are similar too."""
    results = PG.result_filter(*document_results(spark, sf_dir))
    ps, keys = K.with_result_key(SIM.prepare(entity_prints(spark, sf_dir)), results)
    scored = cut_lineage(SIM.similar_groups(ps, KEYS, BAND, agree=keys)[0])
    return results(scored).select("a_id", "b_id", "matched", "total_a", "total_b")


@query(
    "K5_full_admission",
    admission_sql(prints_ctes(), ENTITY_IDS, SAME_KEYS_IN_BAND, DIRECT_SQL, ENTITIES + ",\n" + _SIG_CTES + ",\n", _SAME_RESULTS),
)
def q_k5(spark, sf_dir):
    """Prints, entities and the results of both back ends must agree."""
    extra = PG.result_filter(T.results_symbolic(spark, sf_dir, with_errors=True), T.results_vcgen(spark, sf_dir))
    return K.admit(entity_prints(spark, sf_dir), None, block=KEYS, band=BAND, extra=extra, direct="direct")


_KW = "|".join(PG.SECTION_KEYWORDS)


@query(
    "P1_program_sections",
    with_(ENTITIES)
    + f""", parts AS (
  SELECT entity_id, unnest(ps) AS decl_text, generate_subscripts(ps, 1) - 1 AS decl_index FROM (
    SELECT entity_id, string_split(regexp_replace(program, '(?m)^({_KW})\\b', chr(2) || '\\1', 'g'),
                                   chr(2)) AS ps FROM entities))
SELECT entity_id, CAST(decl_index AS INTEGER) AS decl_index,
  CASE WHEN regexp_extract(decl_text, '^({_KW})\\b', 1) = '' THEN 'extension'
       ELSE regexp_extract(decl_text, '^({_KW})\\b', 1) END AS section,
  md5(decl_text) AS decl_md5
FROM parts WHERE decl_text <> ''""",
)
def q_p1(spark, sf_dir):
    secs = PG.program_sections(T.entities(spark, sf_dir))
    return secs.select("entity_id", "decl_index", "section", F.md5("decl_text").alias("decl_md5"))


@query(
    "P2_split_conjunctions",
    "WITH " + prints_ctes() + """
SELECT p.doc_id, CAST(1 + (SELECT count(*) FROM d_lines l WHERE l.doc_id = p.doc_id)
  + (SELECT count(*) FROM doc_sents s WHERE s.doc_id = p.doc_id)
  + (SELECT count(*) FROM d_words w WHERE w.doc_id = p.doc_id AND lower(w.word) <> 'and') AS BIGINT) AS n_nodes
FROM prints p""",
)
def q_p2(spark, sf_dir):
    """Documents as node tables with sentences as the specification kind: 'and' items are dissolved."""
    nodes = FP.document_nodes(T.read(spark, sf_dir, "documents"))
    out = PG.split_conjunctions(nodes, and_kind="and", spec_kinds=("sentence",))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(
    "W5_occurrence_rank",
    "WITH " + prints_ctes() + """
SELECT doc_id, h AS hash, CAST(row_number() OVER (PARTITION BY doc_id, h ORDER BY li, si) AS INTEGER) AS occurrence
FROM doc_sents""",
)
def q_w5(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    pr = FP.node_table_prints(FP.document_nodes(docs), together=is_spread(docs))
    ranked = FP.occurrence_rank(pr.where("depth = 2"))
    return ranked.select("doc_id", "hash", F.col("occurrence").cast("int").alias("occurrence"))


@query(
    "C2_offset_to_line",
    """SELECT doc_id AS entity_id,
  CAST(len(string_split(substr(text, 1, length(regexp_extract(text, '^[^0-9]*'))), chr(10))) AS INTEGER) AS line
FROM documents WHERE regexp_matches(text, '[0-9]')""",
)
def q_c2(spark, sf_dir):
    e = T.entities(spark, sf_dir).where(F.col("program").rlike("[0-9]"))
    off = F.length(F.regexp_extract("program", "^[^0-9]*", 0))
    return e.select("entity_id", S.offset_to_line(F.col("program"), off).alias("line"))


def _c5_sql() -> str:
    base = _C4_ARGS_SQL.replace(
        "list_concat(['--timeout', CAST(turn AS VARCHAR), '--z3Exe', role],",
        "list_concat(['--extra'], CASE WHEN role = 'user' THEN list_concat(['--timeout', CAST(turn AS VARCHAR), "
        "'--z3Exe', role],",
    ).replace("['--printMethodCFGs', '--randomFlag', '--cvc5Exe', '--timeout']) AS args",
              "['--printMethodCFGs', '--randomFlag', '--cvc5Exe', '--timeout']) ELSE []::VARCHAR[] END) AS args")
    body = _strip_sql(S.STRIP_FLAGS_SYMBOLIC)
    last = f"s{len(S.STRIP_FLAGS_SYMBOLIC)}"
    body = body[: body.rindex("\nSELECT")] + (
        f"\nSELECT conv_id, turn, CAST(len(a) + 2 AS INTEGER) AS n_args, "
        f"md5(array_to_string(list_concat(a, ['--timeout', CAST(least(greatest(CAST(trunc(turn * 1000 * 5.0 / 1000) "
        f"AS INTEGER), 10), 600) AS VARCHAR)]), ' ')) AS args_md5 FROM {last}"
    )
    return base + body


@query("C5_rerun_args", _c5_sql())
def q_c5(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations")
    args = F.concat(
        F.array(F.lit("--timeout"), F.col("turn").cast("string"), F.lit("--z3Exe"), F.col("role")),
        F.split(F.col("text"), " ", -1),
        F.array(F.lit("--printMethodCFGs"), F.lit("--randomFlag"), F.lit("--cvc5Exe"), F.lit("--timeout")),
    )
    out = S.rerun_args(F.array(F.lit("--extra")), args, F.col("role") == "user", S.time_budget(F.col("turn") * 1000))
    return c.select("conv_id", "turn", F.size(out).cast("int").alias("n_args"),
                    F.md5(F.array_join(out, " ")).alias("args_md5"))


@query(
    "C14_timeout_errors",
    with_(RESULTS_SYMBOLIC, ORDER_ERRORS, RESULTS_SYMBOLIC_ERR)
    + "SELECT result_id, contains(lower(array_to_string(errs, chr(1))), 'no') AS timed_out FROM results_symbolic_err",
)
def q_c14(spark, sf_dir):
    r = T.results_symbolic(spark, sf_dir, with_errors=True)
    return r.select("result_id", S.has_timeout_error("errors", "no").alias("timed_out"))


@query("C18_with_field", "SELECT event_id, value * 2 AS value, event_type FROM events")
def q_c18(spark, sf_dir):
    ev = T.read(spark, sf_dir, "events").select(F.struct("event_id", "value", "event_type").alias("s"))
    return ev.select(S.with_field("s", "value", F.col("s.value") * 2).alias("s")).select("s.*")


@query("S5_append_roundtrip", "SELECT count(*) * 2 AS n_rows FROM labels")
def q_s5(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"append-{uuid.uuid4().hex}")
    lb = T.read(spark, sf_dir, "labels")
    FS.append_table(lb, path)
    FS.append_table(lb, path)
    return spark.read.parquet(path).select(F.count(F.lit(1)).alias("n_rows"))


@query("S11_clear_table", "SELECT count(*) * 0 AS n_rows FROM orders")
def q_s11(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"clear-{uuid.uuid4().hex}")
    T.read(spark, sf_dir, "orders").write.parquet(path)
    FS.clear_table(spark, path)
    return spark.read.parquet(path).select(F.count(F.lit(1)).alias("n_rows"))


@query("S15_program_files", "SELECT doc_id AS entity_id, length(text) AS n_chars, md5(text) AS md5 FROM documents")
def q_s15(spark, sf_dir):
    """All texts written to containers and read back byte for byte."""
    path = os.path.join(checkpoint_dir(spark), f"programs-{uuid.uuid4().hex}")
    FS.write_text_container(T.read(spark, sf_dir, "documents"), path, "doc_id", "text")
    texts = FS.read_text_container(spark, path)
    return texts.select(F.col("id").alias("entity_id"), F.length("program").cast("bigint").alias("n_chars"), F.md5("content").alias("md5"))


@query(
    "S16_json_results",
    with_(RESULTS_SYMBOLIC) + "SELECT result_id, entity_id, runtime, success FROM results_symbolic",
)
def q_s16(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    r = T.results_symbolic(spark, sf_dir).select("result_id", "entity_id", "runtime", "success")
    FS.write_json_results(r, path)
    return FS.read_json_results(spark, path, r.schema)


@query(
    "F7_ids_of_answer",
    with_(ENTITIES) + "SELECT entity_id FROM entities WHERE frontend = 'src3' AND loc BETWEEN 2 AND 60",
)
def q_f7(spark, sf_dir):
    from vellum.operators import lookup

    ans = lookup.metadata_filter(T.entities(spark, sf_dir), min_loc=2, max_loc=60, frontend="src3")
    return lookup.ids_of(ans)


@query(
    "T3_first_row",
    "SELECT o_orderkey AS result_id, o_orderdate AS creation_date FROM orders WHERE o_orderstatus = 'P' "
    "ORDER BY o_orderdate, o_orderkey LIMIT 1",
)
def q_t3(spark, sf_dir):
    from vellum.operators import lookup

    r = T.results_symbolic(spark, sf_dir).where("did_timeout").select("result_id", "creation_date")
    return lookup.first_row(r, ["creation_date", "result_id"])


@query("A2_approx_distinct_entities", None, note="HyperLogLog estimate; compare against A2 within its error")
def q_a2a(spark, sf_dir):
    from vellum.operators import counts

    return counts.approx_distinct_entity_count(T.results_symbolic(spark, sf_dir))


@query(
    "K1_stream_accept",
    "SELECT event_id AS submission_id, CAST(" + loc_sql("props")
    + " AS INTEGER) AS loc, ts AS submission_date, event_type AS frontend FROM events",
)
def q_k1s(spark, sf_dir):
    """Structured Streaming over the events file: every event becomes a queued submission."""
    base = os.path.join(checkpoint_dir(spark), f"accept-{uuid.uuid4().hex}")
    table = f"{sf_dir}/events.parque[t]"  # as a pattern it stands for one file and for a folder of part files alike
    q = K.start_accept_stream(spark, table, os.path.join(base, "queue"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "queue")).select("submission_id", "loc", "submission_date", "frontend")

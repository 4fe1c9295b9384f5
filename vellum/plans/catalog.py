"""Registered queries, part 1: scans, look-ups, search, counts, windows, sets, versions, scalars.

Every query reads the given tables (whole) and returns a DataFrame whose columns are aliased
identically in the oracle SQL. Keys are ``<inventory id>_<slug>``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.operators import counts, lookup, search, versions
from vellum.plans.oracle_views import (
    CUSTOMER_ENTITIES,
    ENTITIES,
    EVENT_QUEUE,
    ORDER_ERRORS,
    RESULTS_VCGEN,
    RESULTS_SYMBOLIC,
    RESULTS_SYMBOLIC_ERR,
    SUBMISSIONS,
    with_,
)
from vellum.plans.registry import query
from vellum.sources import tables as T

# Parameters of the registered queries (fixed so Spark and SQL answer the same question).
DIGITS = "[0-9]"
DIGIT_RUNS = "[0-9]+"
META = dict(earliest="2024-01-01 00:01:00", latest="2024-01-02 00:00:00", min_loc=2, max_loc=60, verifier="en",
            parse_success=True)
V1, V2 = "1-URGENT", "2-HIGH"
TIME_FACTOR = 1.5


# ----------------------------------------------------------------------------------------------------------
# Flagship (F3 + F10 + A5): per source, documents of a size range whose text holds a digit.
# ----------------------------------------------------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str):
    ents = T.entities(spark, sf_dir)
    chosen = lookup.metadata_filter(ents, min_loc=META["min_loc"], max_loc=META["max_loc"])
    ids = search.regex_ids(chosen, DIGITS)
    return counts.frontend_count_by_ids(ents, ids).select("frontend", F.col("n").alias("n_docs"))


query(
    "A5_frontend_count_by_ids",
    with_(ENTITIES)
    + f"""SELECT frontend, count(*) AS n_docs FROM entities
WHERE entity_id IN (SELECT entity_id FROM entities WHERE loc BETWEEN {META['min_loc']} AND {META['max_loc']}
                    AND regexp_matches(program, '{DIGITS}'))
GROUP BY frontend""",
)(flagship)


@query(
    "F3_metadata_filter",
    with_(ENTITIES)
    + f"""SELECT entity_id, loc, frontend, original_verifier FROM entities
WHERE submission_date >= TIMESTAMP '{META['earliest']}' AND submission_date <= TIMESTAMP '{META['latest']}'
  AND loc >= {META['min_loc']} AND loc <= {META['max_loc']} AND original_verifier = '{META['verifier']}'
  AND parse_success = true""",
)
def q_f3(spark, sf_dir):
    return lookup.metadata_filter(T.entities(spark, sf_dir), **META).select(
        "entity_id", "loc", "frontend", "original_verifier"
    )


@query("F10_regex_ids", with_(ENTITIES) + f"SELECT entity_id FROM entities WHERE regexp_matches(program, '{DIGITS}')")
def q_f10(spark, sf_dir):
    return search.regex_ids(T.entities(spark, sf_dir), DIGITS)


@query(
    "S1_scan_entities",
    with_(ENTITIES)
    + "SELECT entity_id, submission_date, program, loc, frontend, original_verifier, original_runtime, parse_success "
    "FROM entities",
)
def q_s1(spark, sf_dir):
    return T.entities(spark, sf_dir).drop("args")


@query("S2_batched_scan", "SELECT doc_id AS entity_id, CAST(length(text) AS BIGINT) AS n_chars_counted FROM documents")
def q_s2(spark, sf_dir):
    """Every entity's text is processed once; Spark hands rows over in batches of its own."""
    return T.entities(spark, sf_dir).select("entity_id", F.length("program").cast("bigint").alias("n_chars_counted"))


@query(
    "S3_scan_submissions",
    with_(SUBMISSIONS) + "SELECT submission_id, submission_date, loc, frontend, original_verifier, success, runtime "
    "FROM submissions",
)
def q_s3(spark, sf_dir):
    return T.submissions(spark, sf_dir).select(
        "submission_id", "submission_date", "loc", "frontend", "original_verifier", "success", "runtime"
    )


@query("F1_point_lookup", with_(ENTITIES) + "SELECT entity_id, loc, frontend FROM entities WHERE entity_id = 7")
def q_f1(spark, sf_dir):
    return lookup.by_id(T.entities(spark, sf_dir), 7).select("entity_id", "loc", "frontend")


@query(
    "F2_ids_lookup",
    with_(ENTITIES)
    + "SELECT entity_id, loc, frontend FROM entities WHERE entity_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def q_f2(spark, sf_dir):
    ids = T.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lookup.by_ids(T.entities(spark, sf_dir), ids).select("entity_id", "loc", "frontend")


@query(
    "F2_results_for_ids",
    with_(RESULTS_SYMBOLIC)
    + "SELECT result_id, entity_id, success FROM results_symbolic WHERE entity_id IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def q_f2b(spark, sf_dir):
    ids = T.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return lookup.by_ids(T.results_symbolic(spark, sf_dir), ids).select("result_id", "entity_id", "success")


@query(
    "F4_results_for_entity",
    with_(RESULTS_SYMBOLIC) + "SELECT result_id, creation_date, success, runtime FROM results_symbolic WHERE entity_id = 10",
)
def q_f4(spark, sf_dir):
    return lookup.results_for_entity(T.results_symbolic(spark, sf_dir), 10).select(
        "result_id", "creation_date", "success", "runtime"
    )


@query(
    "F5_results_for_version",
    with_(RESULTS_SYMBOLIC)
    + f"SELECT result_id, entity_id, success, did_timeout, runtime FROM results_symbolic WHERE version_hash = '{V1}'",
)
def q_f5(spark, sf_dir):
    return lookup.results_for_version(T.results_symbolic(spark, sf_dir), V1).select(
        "result_id", "entity_id", "success", "did_timeout", "runtime"
    )


@query(
    "F6_ids_by_result_data",
    with_(RESULTS_SYMBOLIC)
    + "SELECT DISTINCT entity_id FROM results_symbolic WHERE success = true AND did_timeout = false "
    "AND runtime >= 100000 AND runtime <= 300000",
)
def q_f6(spark, sf_dir):
    return lookup.entity_ids_by_result_data(
        T.results_symbolic(spark, sf_dir), success=True, did_timeout=False, min_runtime=100000, max_runtime=300000
    )


@query(
    "F6_ids_by_vcgen_data",
    with_(RESULTS_VCGEN)
    + "SELECT DISTINCT entity_id FROM results_vcgen WHERE success = false AND did_timeout = true",
)
def q_f6b(spark, sf_dir):
    return lookup.entity_ids_by_result_data(T.results_vcgen(spark, sf_dir), success=False, did_timeout=True)


@query("F8_find_term", with_(ENTITIES) + "SELECT entity_id FROM entities WHERE contains(program, 'the ')")
def q_f8(spark, sf_dir):
    return lookup.find_term(T.entities(spark, sf_dir), "the ")


@query(
    "F11_does_match",
    with_(ENTITIES) + "SELECT entity_id, regexp_matches(program, '(?i)licen[cs]e') AS hit FROM entities",
)
def q_f11(spark, sf_dir):
    e = T.entities(spark, sf_dir)
    return e.select("entity_id", search.does_match(F.col("program"), "licen[cs]e", flags=0x02).alias("hit"))


@query(
    "F12_matches_any",
    with_(ENTITIES)
    + "SELECT entity_id, (regexp_matches(program, '[0-9]') OR regexp_matches(program, 'license') "
    "OR regexp_matches(program, '@')) AS hit FROM entities",
)
def q_f12(spark, sf_dir):
    e = T.entities(spark, sf_dir)
    return e.select("entity_id", search.matches_at_least_one(F.col("program"), ["[0-9]", "license", "@"]).alias("hit"))


_F9_SQL = """, marked AS (
  SELECT entity_id, regexp_replace(program, '{pat}', chr(57344) || '\\0', 'g') AS m
  FROM entities WHERE regexp_matches(program, '{pat}')),
lines AS (
  SELECT entity_id, unnest(string_split(m, chr(10))) AS ln, generate_subscripts(string_split(m, chr(10)), 1) AS line
  FROM marked)
SELECT entity_id, CAST(line AS INTEGER) AS line, CAST(len(string_split(ln, chr(57344))) - 1 AS INTEGER) AS hits
FROM lines WHERE len(string_split(ln, chr(57344))) > 1"""


@query("F9_regex_lines", with_(ENTITIES)[:-1] + _F9_SQL.format(pat=DIGIT_RUNS))
def q_f9(spark, sf_dir):
    return search.regex_line_hits(T.entities(spark, sf_dir), DIGIT_RUNS)


@query(
    "F9_regex_lines_email",
    with_(ENTITIES)[:-1] + _F9_SQL.format(pat="[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+"),
)
def q_f9b(spark, sf_dir):
    return search.regex_line_hits(T.entities(spark, sf_dir), "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+")


@query(
    "F13_regex_all_entities",
    with_(ENTITIES)
    + f"""SELECT entity_id, CAST(len(regexp_extract_all(program, '{DIGIT_RUNS}')) AS INTEGER) AS n_matches,
  CAST(CASE WHEN regexp_matches(program, '{DIGIT_RUNS}')
       THEN len(string_split(regexp_extract(program, '^[^0-9]*'), chr(10))) END AS INTEGER) AS first_line
FROM entities""",
)
def q_f13(spark, sf_dir):
    out = search.regex_lines(T.entities(spark, sf_dir), DIGIT_RUNS, keep_empty=True)
    return out.select(
        "entity_id", F.size("lines").cast("int").alias("n_matches"), F.try_element_at("lines", F.lit(1)).alias("first_line")
    )


@query(
    "F14_per_line_matches",
    with_(ENTITIES)
    + f"""SELECT entity_id, CAST(i - 1 AS INTEGER) AS line_index FROM (
  SELECT entity_id, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM (
    SELECT entity_id,
      CASE WHEN program = '' THEN [''] WHEN regexp_replace(program, '\\n+\\z', '') = '' THEN []::VARCHAR[]
           ELSE string_split(regexp_replace(program, '\\n+\\z', ''), chr(10)) END AS ls
    FROM entities))
WHERE regexp_matches(ln, '{DIGITS}')""",
)
def q_f14(spark, sf_dir):
    return search.per_line_matches(T.entities(spark, sf_dir), DIGITS)


@query("C1_loc", with_(ENTITIES) + "SELECT entity_id, loc FROM entities")
def q_c1(spark, sf_dir):
    return T.entities(spark, sf_dir).select("entity_id", "loc")


@query("C3_short_md5", "SELECT doc_id AS entity_id, substr(md5(text), 1, 16) AS program_hash FROM documents")
def q_c3(spark, sf_dir):
    return T.entities(spark, sf_dir).select("entity_id", S.short_md5("program").alias("program_hash"))


# ----------------------------------------------------------------------------------------------------------
# Counts
# ----------------------------------------------------------------------------------------------------------
@query(
    "A1_table_counts",
    """SELECT 'submissions' AS table_name, count(*) AS n_rows FROM benchmark
UNION ALL SELECT 'entities', count(*) FROM documents
UNION ALL SELECT 'symbolic_results', count(*) FROM orders
UNION ALL SELECT 'vcgen_results', count(*) FROM events
UNION ALL SELECT 'const_features', count(*) * 2 FROM labels
UNION ALL SELECT 'prints', count(*) FROM documents
UNION ALL SELECT 'feature_names', 2 FROM (SELECT count(*) FROM labels)""",
)
def q_a1(spark, sf_dir):
    from vellum.operators.fingerprint import document_prints
    from vellum.sources.tables import label_features

    return counts.table_counts(
        submissions=T.submissions(spark, sf_dir),
        entities=T.entities(spark, sf_dir),
        symbolic_results=T.results_symbolic(spark, sf_dir),
        vcgen_results=T.results_vcgen(spark, sf_dir),
        const_features=label_features(spark, sf_dir),
        prints=document_prints(T.read(spark, sf_dir, "documents")),
        feature_names=label_features(spark, sf_dir).select("feature_name").distinct(),
    )


@query("A2_distinct_entities", "SELECT count(DISTINCT o_custkey) AS n_entities FROM orders")
def q_a2(spark, sf_dir):
    return counts.distinct_entity_count(T.results_symbolic(spark, sf_dir))


@query(
    "A3_entity_counts",
    with_(ENTITIES)
    + """SELECT count(*) FILTER (WHERE frontend = 'src1') AS n_frontend,
  count(*) FILTER (WHERE original_verifier = 'en') AS n_verifier,
  count(*) FILTER (WHERE parse_success) AS n_parsed FROM entities""",
)
def q_a3(spark, sf_dir):
    return counts.filtered_counts(
        T.entities(spark, sf_dir),
        n_frontend=F.col("frontend") == "src1",
        n_verifier=F.col("original_verifier") == "en",
        n_parsed=F.col("parse_success"),
    )


@query(
    "A3_result_counts",
    with_(RESULTS_SYMBOLIC, RESULTS_VCGEN)
    + """SELECT (SELECT count(*) FROM results_symbolic WHERE success) AS n_symbolic_success,
  (SELECT count(*) FROM results_vcgen WHERE success) AS n_vcgen_success""",
)
def q_a3b(spark, sf_dir):
    a = counts.filtered_counts(T.results_symbolic(spark, sf_dir), n_symbolic_success=F.col("success"))
    b = counts.filtered_counts(T.results_vcgen(spark, sf_dir), n_vcgen_success=F.col("success"))
    stacked = a.unionByName(b, allowMissingColumns=True)
    return stacked.select(F.max("n_symbolic_success").alias("n_symbolic_success"), F.max("n_vcgen_success").alias(
        "n_vcgen_success"))


@query(
    "A4_range_counts",
    with_(ENTITIES, RESULTS_SYMBOLIC, RESULTS_VCGEN)
    + """SELECT (SELECT count(*) FROM entities WHERE loc BETWEEN 5 AND 50) AS n_loc,
  (SELECT count(*) FROM results_symbolic WHERE runtime BETWEEN 100000 AND 200000) AS n_symbolic_runtime,
  (SELECT count(*) FROM results_vcgen WHERE runtime BETWEEN 1000 AND 5000) AS n_vcgen_runtime""",
)
def q_a4(spark, sf_dir):
    parts = [
        counts.filtered_counts(T.entities(spark, sf_dir), n_loc=counts.between("loc", 5, 50)),
        counts.filtered_counts(
            T.results_symbolic(spark, sf_dir), n_symbolic_runtime=counts.between("runtime", 100000, 200000)
        ),
        counts.filtered_counts(T.results_vcgen(spark, sf_dir), n_vcgen_runtime=counts.between("runtime", 1000, 5000)),
    ]
    st = parts[0]
    for p in parts[1:]:
        st = st.unionByName(p, allowMissingColumns=True)
    return st.select(*[F.max(c).alias(c) for c in ("n_loc", "n_symbolic_runtime", "n_vcgen_runtime")])


@query(
    "A8_mean_stdev_by_version",
    with_(RESULTS_SYMBOLIC)
    + """SELECT version_hash, round(avg(runtime), 4) AS mean, round(stddev_samp(runtime), 4) AS stdev, count(*) AS n
FROM results_symbolic GROUP BY version_hash""",
)
def q_a8(spark, sf_dir):
    r = counts.mean_stdev_by(T.results_symbolic(spark, sf_dir), "version_hash", "runtime")
    return r.select("version_hash", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), "n")


@query("A10_mean_loc", with_(ENTITIES) + "SELECT round(avg(loc), 6) AS mean_loc FROM entities")
def q_a10(spark, sf_dir):
    return counts.mean_of(T.entities(spark, sf_dir), "loc", "mean_loc").select(F.round("mean_loc", 6).alias("mean_loc"))


@query("A14_any_toxic_by_quality", "SELECT quality, bool_or(toxic = 1) AS any_true FROM labels GROUP BY quality")
def q_a14(spark, sf_dir):
    lb = T.read(spark, sf_dir, "labels")
    return counts.any_true(lb, F.col("toxic") == 1, "quality")


# ----------------------------------------------------------------------------------------------------------
# Windows, sorts, set operations
# ----------------------------------------------------------------------------------------------------------
@query(
    "W1_latest_result",
    with_(RESULTS_SYMBOLIC)
    + """SELECT entity_id, creation_date, result_id, runtime FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY creation_date DESC, result_id DESC) AS rn
  FROM results_symbolic) WHERE rn = 1""",
)
def q_w1(spark, sf_dir):
    r = T.results_symbolic(spark, sf_dir).select("entity_id", "creation_date", "result_id", "runtime")
    return lookup.latest_per_entity(r).select("entity_id", "creation_date", "result_id", "runtime")


@query(
    "W2_oldest_submission",
    with_(EVENT_QUEUE)
    + "SELECT submission_id, submission_date FROM event_queue ORDER BY submission_date, submission_id LIMIT 1",
)
def q_w2(spark, sf_dir):
    return lookup.oldest(T.event_queue(spark, sf_dir)).select("submission_id", "submission_date")


@query(
    "W3_gap_per_user",
    """SELECT event_id, user_id,
  CAST(epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch_us(ts))
       AS BIGINT) AS gap_us
FROM events""",
)
def q_w3(spark, sf_dir):
    from vellum.operators.sequences import gap_to_previous

    ev = T.read(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us")
    )
    return gap_to_previous(ev, key="user_id", order=["t_us", "event_id"], value="t_us", out="gap_us").select(
        "event_id", "user_id", "gap_us"
    )


@query(
    "U4_set_union",
    "SELECT doc_id AS entity_id FROM documents WHERE regexp_matches(text, '[0-9]') "
    "UNION SELECT doc_id FROM documents WHERE contains(text, 'license')",
)
def q_u4(spark, sf_dir):
    e = T.entities(spark, sf_dir)
    return lookup.set_union(search.regex_ids(e, DIGITS), lookup.find_term(e, "license"))


# ----------------------------------------------------------------------------------------------------------
# Versions
# ----------------------------------------------------------------------------------------------------------
@query(
    "J3_missing_version",
    with_(CUSTOMER_ENTITIES, RESULTS_SYMBOLIC)
    + f"""SELECT entity_id FROM customer_entities c WHERE NOT EXISTS (
  SELECT 1 FROM results_symbolic r WHERE r.entity_id = c.entity_id AND r.version_hash = '{V1}')""",
)
def q_j3(spark, sf_dir):
    return versions.missing_version(T.customer_entities(spark, sf_dir), T.results_symbolic(spark, sf_dir), V1)


@query(
    "K6_rerun_backlog",
    with_(CUSTOMER_ENTITIES, RESULTS_SYMBOLIC)
    + f"""SELECT entity_id, CAST(trunc(original_runtime * 5.0 / 1000) AS INTEGER) AS timeout_seconds
FROM customer_entities c WHERE NOT EXISTS (
  SELECT 1 FROM results_symbolic r WHERE r.entity_id = c.entity_id AND r.version_hash = '{V1}')""",
)
def q_k6(spark, sf_dir):
    return versions.rerun_backlog(T.customer_entities(spark, sf_dir), T.results_symbolic(spark, sf_dir), V1)


@query(
    "J7_shared_entities",
    with_(RESULTS_SYMBOLIC)
    + f"""SELECT entity_id FROM (SELECT entity_id FROM results_symbolic WHERE version_hash = '{V1}'
  INTERSECT ALL SELECT entity_id FROM results_symbolic WHERE version_hash = '{V2}')""",
)
def q_j7(spark, sf_dir):
    return versions.shared_entities(T.results_symbolic(spark, sf_dir), V1, V2)


_VERSION_SIDES = f""", a AS (SELECT * FROM results_symbolic_err WHERE version_hash = '{V1}'
  AND entity_id IN (SELECT entity_id FROM results_symbolic WHERE version_hash = '{V2}')),
b AS (SELECT * FROM results_symbolic_err WHERE version_hash = '{V2}'
  AND entity_id IN (SELECT entity_id FROM results_symbolic WHERE version_hash = '{V1}')),
diffs AS (
  SELECT 'success' AS kind, a.entity_id, a.result_id FROM a
    WHERE EXISTS (SELECT 1 FROM b WHERE b.entity_id = a.entity_id AND b.success <> a.success)
  UNION ALL
  SELECT 'runtime', a.entity_id, a.result_id FROM a
    WHERE EXISTS (SELECT 1 FROM b WHERE b.entity_id = a.entity_id
      AND (a.runtime <= b.runtime / {TIME_FACTOR} OR a.runtime >= b.runtime * {TIME_FACTOR}))
  UNION ALL
  SELECT 'errors', a.entity_id, a.result_id FROM a
    WHERE EXISTS (SELECT 1 FROM b WHERE b.entity_id = a.entity_id AND b.errs <> a.errs))
"""


@query(
    "J6_version_diffs",
    with_(RESULTS_SYMBOLIC, ORDER_ERRORS, RESULTS_SYMBOLIC_ERR)[:-1] + _VERSION_SIDES + "SELECT kind, entity_id, result_id FROM diffs",
)
def q_j6(spark, sf_dir):
    return versions.version_diffs(T.results_symbolic(spark, sf_dir, with_errors=True), V1, V2, TIME_FACTOR)


@query(
    "A7_version_summary",
    with_(RESULTS_SYMBOLIC, ORDER_ERRORS, RESULTS_SYMBOLIC_ERR)[:-1]
    + _VERSION_SIDES
    + f""", ma AS (SELECT count(*) AS n, coalesce(sum(runtime::HUGEINT), 0) AS sx,
                 coalesce(sum(runtime::HUGEINT * runtime::HUGEINT), 0) AS sxx FROM a),
mb AS (SELECT count(*) AS n, coalesce(sum(runtime::HUGEINT), 0) AS sx,
                 coalesce(sum(runtime::HUGEINT * runtime::HUGEINT), 0) AS sxx FROM b)
SELECT '{V1}' AS v1, '{V2}' AS v2,
  (SELECT count(*) FROM (SELECT entity_id FROM results_symbolic WHERE version_hash = '{V1}'
     INTERSECT ALL SELECT entity_id FROM results_symbolic WHERE version_hash = '{V2}')) AS n_shared,
  (SELECT count(*) FROM diffs WHERE kind = 'success') AS n_success_diff,
  (SELECT count(*) FROM diffs WHERE kind = 'runtime') AS n_runtime_diff,
  (SELECT count(*) FROM diffs WHERE kind = 'errors') AS n_error_diff,
  CAST(CASE WHEN ma.n > 0 THEN ma.sx // ma.n ELSE 0 END AS BIGINT) AS avg_runtime1,
  CAST(CASE WHEN mb.n > 0 THEN mb.sx // mb.n ELSE 0 END AS BIGINT) AS avg_runtime2,
  CAST(CASE WHEN ma.n > 0 THEN (ma.sxx - 2 * (ma.sx // ma.n) * ma.sx + ma.n * (ma.sx // ma.n) * (ma.sx // ma.n)) // ma.n
       ELSE 0 END AS BIGINT) AS var_runtime1,
  CAST(CASE WHEN mb.n > 0 THEN (mb.sxx - 2 * (mb.sx // mb.n) * mb.sx + mb.n * (mb.sx // mb.n) * (mb.sx // mb.n)) // mb.n
       ELSE 0 END AS BIGINT) AS var_runtime2
FROM ma, mb""",
)
def q_a7(spark, sf_dir):
    return versions.version_diff_summary(T.results_symbolic(spark, sf_dir, with_errors=True), V1, V2, TIME_FACTOR)


# ----------------------------------------------------------------------------------------------------------
# Scalars
# ----------------------------------------------------------------------------------------------------------
@query(
    "C6_time_budget",
    with_(RESULTS_VCGEN)
    + """SELECT result_id, runtime,
  least(greatest(CAST(trunc(runtime * 5.0 / 1000) AS INTEGER), 10), 600) AS budget_seconds,
  CAST(trunc(runtime * 5.0 / 1000) AS INTEGER) AS rerun_seconds
FROM results_vcgen""",
)
def q_c6(spark, sf_dir):
    r = T.results_vcgen(spark, sf_dir)
    return r.select(
        "result_id", "runtime", S.time_budget("runtime").alias("budget_seconds"), S.rerun_budget("runtime").alias(
            "rerun_seconds")
    )


@query(
    "C8_millis_to_timestamp",
    "SELECT event_id, make_timestamp(CAST(floor(value * 1000) AS BIGINT) * 1000 + 1700000000000000) AS at "
    "FROM events",
)
def q_c8(spark, sf_dir):
    ev = T.read(spark, sf_dir, "events")
    ms = F.floor(F.col("value") * 1000).cast("bigint") + F.lit(1700000000000)
    return ev.select("event_id", S.millis_to_timestamp(ms).alias("at"))


@query(
    "C15_runtime_differs",
    with_(RESULTS_SYMBOLIC)
    + f"""SELECT result_id,
  (runtime <= (runtime + 1000) / {TIME_FACTOR} OR runtime >= (runtime + 1000) * {TIME_FACTOR}) AS differs
FROM results_symbolic""",
)
def q_c15(spark, sf_dir):
    r = T.results_symbolic(spark, sf_dir)
    return r.select("result_id", S.runtime_differs(F.col("runtime"), F.col("runtime") + 1000, TIME_FACTOR).alias(
        "differs"))

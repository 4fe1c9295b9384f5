"""DuckDB SQL for the logical tables, mirroring ``vellum.sources.tables`` (used only by oracle SQL).

Each constant is a ``name AS (...)`` common table expression over the raw input views.
"""

LOC_SQL = (
    "CASE WHEN {t} = '' THEN 1 "
    "WHEN regexp_replace({t}, '\\n+\\z', '') = '' THEN 0 "
    "ELSE len(string_split(regexp_replace({t}, '\\n+\\z', ''), chr(10))) END"
)


def loc_sql(t: str) -> str:
    return LOC_SQL.format(t=t)


ENTITIES = f"""entities AS (
  SELECT doc_id AS entity_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS submission_date,
         text AS program,
         CAST({loc_sql('text')} AS INTEGER) AS loc,
         source AS frontend,
         lang AS original_verifier,
         n_chars AS original_runtime,
         ({loc_sql('text')}) > 1 AS parse_success
  FROM documents)"""

SUBMISSIONS = f"""submissions AS (
  SELECT item_id AS submission_id,
         TIMESTAMP '2025-01-01 00:00:00' + to_seconds(item_id) AS submission_date,
         text AS program,
         CAST({loc_sql('text')} AS INTEGER) AS loc,
         'Generic' AS frontend, 'symbolic' AS original_verifier, true AS success, CAST(1500 AS BIGINT) AS runtime
  FROM benchmark)"""

EVENT_QUEUE = f"""event_queue AS (
  SELECT event_id AS submission_id, ts AS submission_date, props AS program,
         CAST({loc_sql('props')} AS INTEGER) AS loc, event_type AS frontend
  FROM events)"""

RESULTS_SYMBOLIC = """results_symbolic AS (
  SELECT o_orderkey AS result_id, o_orderdate AS creation_date, o_orderpriority AS version_hash,
         o_custkey AS entity_id, o_orderstatus = 'F' AS success, o_orderstatus = 'P' AS did_timeout,
         CAST(floor(o_totalprice) AS BIGINT) AS runtime
  FROM orders)"""

ORDER_ERRORS = """order_errors AS (
  SELECT l_orderkey AS result_id, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS error_ids
  FROM lineitem GROUP BY l_orderkey)"""

RESULTS_SYMBOLIC_ERR = """results_symbolic_err AS (
  SELECT r.*, coalesce(e.error_ids, []::VARCHAR[]) AS errs
  FROM results_symbolic r LEFT JOIN order_errors e USING (result_id))"""

RESULTS_VCGEN = """results_vcgen AS (
  SELECT event_id AS result_id, ts AS creation_date, event_type AS version_hash, user_id AS entity_id,
         value <= 100 AS success, value > 300 AS did_timeout, CAST(floor(value * 100) AS BIGINT) AS runtime
  FROM events)"""

CUSTOMER_ENTITIES = """customer_entities AS (
  SELECT c_custkey AS entity_id, c_mktsegment AS frontend,
         CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) AS original_runtime
  FROM customer)"""

FEATURE_ENTRIES = """feature_entries AS (
  SELECT 'returnflag' AS feature_name, 'symbolic' AS ref_kind, l_orderkey AS ref_id, l_returnflag AS value FROM lineitem
  UNION ALL
  SELECT 'linestatus', 'symbolic', l_orderkey, l_linestatus FROM lineitem
  UNION ALL
  SELECT 'props_k', 'vcgen', event_id, json_extract_string(props, '$.k') FROM events
  UNION ALL
  SELECT 'segment', 'const', c_custkey, c_mktsegment FROM customer)"""

LABEL_FEATURES = """label_features AS (
  SELECT 'quality' AS feature_name, 'const' AS ref_kind, doc_id AS ref_id, CAST(quality AS VARCHAR) AS value FROM labels
  UNION ALL
  SELECT 'toxic', 'const', doc_id, CAST(toxic AS VARCHAR) FROM labels)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Document prints (root -> line -> sentence -> word), mirroring vellum.operators.fingerprint.document_prints.
# Produces: doc_lines(doc_id, li, h, w0, nks), doc_sents(doc_id, li, si, h, w), prints(doc_id, root_hash, weight,
# total), tokens(doc_id, level, h, cnt, w), line_kids(lh, sh, k).
def prints_ctes(source: str = "documents", id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> str:
    """The CTEs below; with ``prefix`` every CTE name starts with it (two print sets in one query)."""
    p = prefix
    return f"""{p}d_lines AS (
  SELECT {id_col} AS doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS li
  FROM (SELECT {id_col}, string_split({text_col}, chr(10)) AS ls FROM {source})),
{p}d_sents AS (
  SELECT doc_id, li, unnest(ps) AS sent, generate_subscripts(ps, 1) AS si
  FROM (SELECT doc_id, li, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps
        FROM {p}d_lines)),
{p}d_words AS (
  SELECT doc_id, li, si, word, wi FROM (
    SELECT doc_id, li, si, unnest(ws) AS word, generate_subscripts(ws, 1) AS wi
    FROM (SELECT doc_id, li, si, string_split_regex(sent, '\\s+') AS ws FROM {p}d_sents))
  WHERE word <> ''),
{p}doc_sents AS (
  SELECT doc_id, li, si,
         md5('sentence:' || string_agg(md5(lower(word) || ':'), ',' ORDER BY wi)) AS h,
         count(*) + 1 AS w
  FROM {p}d_words GROUP BY doc_id, li, si),
{p}doc_lines AS (
  SELECT l.doc_id, l.li,
         md5('line:' || coalesce(string_agg(s.h, ',' ORDER BY s.si), '')) AS h,
         1 + coalesce(sum(s.w), 0) AS w0,
         count(s.h) FILTER (WHERE s.w > 3) AS nks
  FROM {p}d_lines l LEFT JOIN {p}doc_sents s ON s.doc_id = l.doc_id AND s.li = l.li
  GROUP BY l.doc_id, l.li),
{p}prints AS (
  SELECT doc_id,
         md5('root:' || string_agg(h, ',' ORDER BY w0 DESC, h DESC)) AS root_hash,
         CAST(1 + sum(w0) AS BIGINT) AS weight,
         CAST(coalesce(sum(1 + nks) FILTER (WHERE w0 > 3), 0) AS BIGINT) AS total
  FROM {p}doc_lines GROUP BY doc_id),
{p}kept_lines AS (SELECT doc_id, li, h, 1 + nks AS w FROM {p}doc_lines WHERE w0 > 3),
{p}kept_sents AS (
  SELECT s.doc_id, s.li, s.si, s.h, k.h AS lh FROM {p}doc_sents s
  JOIN {p}kept_lines k ON k.doc_id = s.doc_id AND k.li = s.li WHERE s.w > 3),
{p}tokens AS (
  SELECT doc_id, 1 AS level, h, count(*) AS cnt, max(w) AS w FROM {p}kept_lines GROUP BY doc_id, h
  UNION ALL
  SELECT doc_id, 2, h, count(*), 1 FROM {p}kept_sents GROUP BY doc_id, h),
{p}line_kids AS (
  SELECT DISTINCT lh, sh, k FROM (
    SELECT lh, doc_id, li, h AS sh, count(*) AS k FROM {p}kept_sents GROUP BY lh, doc_id, li, h))"""


# Exact matched weight for a relation pairs(a_id, b_id), mirroring similarity.matched_weight. ``a`` / ``b``: CTE
# name prefixes of the print sets the two sides come from; ``kids``: the line-children table to use.
def matched_ctes(a: str = "", b: str = "", kids: str = "line_kids") -> str:
    return f"""pl AS (
  SELECT p.a_id, p.b_id, t.h, t.cnt AS ca, 0 AS cb, t.w FROM pairs p JOIN {a}tokens t ON t.doc_id = p.a_id AND t.level = 1
  UNION ALL
  SELECT p.a_id, p.b_id, t.h, 0, t.cnt, t.w FROM pairs p JOIN {b}tokens t ON t.doc_id = p.b_id AND t.level = 1),
plines AS (SELECT a_id, b_id, h, sum(ca) AS ca, sum(cb) AS cb, max(w) AS w, least(sum(ca), sum(cb)) AS m
           FROM pl GROUP BY a_id, b_id, h),
m1 AS (SELECT a_id, b_id, sum(m * w) AS m1 FROM plines GROUP BY a_id, b_id),
pools AS (SELECT a_id, b_id, sh, sum((ca - m) * k) AS pa, sum((cb - m) * k) AS pb
          FROM plines JOIN {kids} lk ON lk.lh = plines.h GROUP BY a_id, b_id, sh),
m2 AS (SELECT a_id, b_id, sum(least(pa, pb)) AS m2 FROM pools GROUP BY a_id, b_id),
scored AS (
  SELECT p.a_id, p.b_id,
         CAST(CASE WHEN pa.root_hash = pb.root_hash THEN pa.total
              ELSE coalesce(m1.m1, 0) + coalesce(m2.m2, 0) END AS BIGINT) AS matched,
         pa.total AS total_a, pb.total AS total_b
  FROM pairs p JOIN {a}prints pa ON pa.doc_id = p.a_id JOIN {b}prints pb ON pb.doc_id = p.b_id
  LEFT JOIN m1 ON m1.a_id = p.a_id AND m1.b_id = p.b_id
  LEFT JOIN m2 ON m2.a_id = p.a_id AND m2.b_id = p.b_id),
decided AS (
  SELECT *, CASE WHEN total_a = 0 THEN 0.0 ELSE 100.0 * (matched / total_a) END AS pct_a,
            CASE WHEN total_b = 0 THEN 0.0 ELSE 100.0 * (matched / total_b) END AS pct_b
  FROM scored),
matches AS (
  SELECT * FROM decided WHERE (pct_a >= 70.0 AND pct_b >= 70.0) OR pct_a >= 99.0 OR pct_b >= 99.0)"""


MATCHED_CTES = matched_ctes()

"""Registered queries, part 2: fingerprints, near-duplicates, similarity decisions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.operators import fingerprint as FP
from vellum.operators import lookup as LK
from vellum.operators import similarity as SIM
from vellum.plans.oracle_views import ENTITIES, MATCHED_CTES, matched_ctes, prints_ctes
from vellum.plans.registry import query
from vellum.session import is_spread
from vellum.sources import tables as T

BAND = (0.5, 2.0)
# Front ends whose items come straight from a verifier (the others' items are generated programs): the first ten sources.
DIRECT_FRONTENDS = [f"src{i}" for i in range(10)]


def doc_prints(spark: SparkSession, sf_dir: str):
    return FP.document_prints(T.read(spark, sf_dir, "documents"))


def entity_prints(spark: SparkSession, sf_dir: str):
    """Prints of the entities, carrying the columns used for blocking (J4) through the same projection."""
    e = T.entities(spark, sf_dir)
    e = e.withColumn("direct", F.col("frontend").isin(DIRECT_FRONTENDS))
    return FP.document_prints(
        e, id_col="entity_id", text_col="program", keep=["loc", "frontend", "original_verifier", "parse_success", "direct"]
    )


@query("S4_scan_prints", "WITH " + prints_ctes() + "\nSELECT doc_id, root_hash, weight, total FROM prints")
def q_s4(spark, sf_dir):
    return doc_prints(spark, sf_dir).select("doc_id", "root_hash", "weight", "total")


@query(
    "A12_subtree_weights",
    "WITH "
    + prints_ctes()
    + """,
lvl AS (
  SELECT doc_id, 0 AS depth, 1 AS n, weight AS sw, 1 AS nk, 1 + total AS stw FROM prints
  UNION ALL
  SELECT doc_id, 1, 1, w0, CASE WHEN w0 > 3 THEN 1 ELSE 0 END, CASE WHEN w0 > 3 THEN 1 + nks ELSE 0 END FROM doc_lines
  UNION ALL
  SELECT doc_id, 2, 1, w, CASE WHEN w > 3 THEN 1 ELSE 0 END, CASE WHEN w > 3 THEN 1 ELSE 0 END FROM doc_sents
  UNION ALL
  SELECT doc_id, 3, 1, 1, 0, 0 FROM d_words)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(sw) AS BIGINT) AS sum_weight,
       CAST(sum(nk) AS BIGINT) AS n_kept, CAST(sum(stw) AS BIGINT) AS sum_tweight
FROM lvl GROUP BY doc_id, depth""",
)
def q_a12(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    pr = FP.node_table_prints(FP.document_nodes(docs), together=is_spread(docs))
    return pr.groupBy("doc_id", "depth").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum("weight").cast("bigint").alias("sum_weight"),
        F.count_if("kept").cast("bigint").alias("n_kept"),
        F.coalesce(F.sum("tweight"), F.lit(0)).cast("bigint").alias("sum_tweight"),
    )


@query(
    "A11_hash_counts",
    "WITH " + prints_ctes() + """
SELECT h, CAST(level AS INTEGER) AS level, count(*) AS n_docs, CAST(sum(cnt) AS BIGINT) AS n_nodes
FROM tokens GROUP BY h, level""",
)
def q_a11(spark, sf_dir):
    toks = FP.print_tokens(doc_prints(spark, sf_dir))
    return toks.groupBy("h", "level").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("cnt").cast("bigint").alias("n_nodes")
    ).select("h", F.col("level").cast("int").alias("level"), "n_docs", "n_nodes")


_REPS = """reps AS (SELECT min(doc_id) AS doc_id FROM prints WHERE total > 0 GROUP BY root_hash),
pairs AS (
  SELECT DISTINCT a.doc_id AS a_id, b.doc_id AS b_id FROM tokens a JOIN tokens b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT doc_id FROM reps) AND b.doc_id IN (SELECT doc_id FROM reps))"""


@query(
    "J9_near_duplicates",
    "WITH " + prints_ctes() + ",\n" + _REPS + ",\n" + MATCHED_CTES + """
SELECT a_id, b_id, matched, total_a, total_b FROM matches""",
)
def q_j9(spark, sf_dir):
    return SIM.near_duplicate_pairs(doc_prints(spark, sf_dir))


@query(
    "J9_copy_groups",
    "WITH " + prints_ctes() + """,
g AS (SELECT root_hash, min(doc_id) AS rep_id, count(*) AS n_copies FROM prints WHERE total > 0 GROUP BY root_hash)
SELECT p.doc_id, g.rep_id, g.n_copies FROM prints p JOIN g USING (root_hash) WHERE g.n_copies > 1""",
)
def q_j9c(spark, sf_dir):
    return SIM.copy_groups(doc_prints(spark, sf_dir)).where("n_copies > 1")


@query(
    "J10_duplicate_members",
    "WITH " + prints_ctes() + ",\n" + _REPS + ",\n" + MATCHED_CTES + """,
g AS (SELECT p.doc_id, x.rep_id, x.n_copies FROM prints p
      JOIN (SELECT root_hash, min(doc_id) AS rep_id, count(*) AS n_copies FROM prints WHERE total > 0 GROUP BY root_hash) x USING (root_hash))
SELECT doc_id FROM g WHERE n_copies > 1 OR rep_id IN (SELECT a_id FROM matches UNION SELECT b_id FROM matches)""",
)
def q_j10(spark, sf_dir):
    return SIM.duplicate_members(doc_prints(spark, sf_dir))


@query(
    "J9_clusters",
    "WITH RECURSIVE " + prints_ctes() + ",\n" + _REPS + ",\n" + MATCHED_CTES + """,
links AS (SELECT a_id AS a, b_id AS b FROM matches UNION ALL SELECT b_id, a_id FROM matches),
reach AS (SELECT doc_id AS id, doc_id AS root FROM reps UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
g AS (SELECT p.doc_id, x.rep_id FROM prints p
      JOIN (SELECT root_hash, min(doc_id) AS rep_id FROM prints WHERE total > 0 GROUP BY root_hash) x USING (root_hash) WHERE p.total > 0)
SELECT * FROM (SELECT g.doc_id, roots.root AS cluster_id, count(*) OVER (PARTITION BY roots.root) AS n_docs FROM g JOIN roots ON roots.id = g.rep_id)
WHERE n_docs > 1""",
)
def q_j9k(spark, sf_dir):
    """Near-duplicate clusters as membership rows; the SQL walks all pairs."""
    return SIM.near_duplicate_clusters(doc_prints(spark, sf_dir))


@query(
    "C10_match_percentages",
    "WITH " + prints_ctes() + ",\n" + _REPS + ",\n" + MATCHED_CTES + """
SELECT a_id, b_id, round(pct_a, 4) AS pct_a, round(pct_b, 4) AS pct_b,
       round(least(pct_a, pct_b), 4) AS pct_min, round(greatest(pct_a, pct_b), 4) AS pct_max FROM matches""",
)
def q_c10(spark, sf_dir):
    pairs = SIM.near_duplicate_pairs(doc_prints(spark, sf_dir))
    s = SIM.with_decision(pairs)
    return s.select(
        "a_id", "b_id", *[F.round(c, 4).alias(c) for c in ("pct_a", "pct_b", "pct_min", "pct_max")]
    )


@query(
    "P13_similarity_report",
    "WITH " + prints_ctes() + ",\n" + _REPS + ",\n" + MATCHED_CTES + """
SELECT da.source = db.source AS expected, count(*) AS n,
       round(avg(least(pct_a, pct_b)), 4) AS mean_min, round(stddev_samp(least(pct_a, pct_b)), 4) AS stdev_min,
       round(avg(greatest(pct_a, pct_b)), 4) AS mean_max, round(stddev_samp(greatest(pct_a, pct_b)), 4) AS stdev_max,
       count(*) AS n_decided_match
FROM matches JOIN documents da ON da.doc_id = a_id JOIN documents db ON db.doc_id = b_id
GROUP BY da.source = db.source""",
)
def q_p13(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "source")
    scored = SIM.with_decision(SIM.near_duplicate_pairs(doc_prints(spark, sf_dir)))
    lab = (
        scored.select("a_id", "b_id")
        .join(docs.select(F.col("doc_id").alias("a_id"), F.col("source").alias("sa")), "a_id")
        .join(docs.select(F.col("doc_id").alias("b_id"), F.col("source").alias("sb")), "b_id")
        .select("a_id", "b_id", (F.col("sa") == F.col("sb")).alias("expected"))
    )
    r = SIM.similarity_report(scored, lab)
    return r.select(
        "expected", "n", *[F.round(c, 4).alias(c) for c in ("mean_min", "stdev_min", "mean_max", "stdev_max")],
        "n_decided_match",
    )


@query(
    "C12_match_report",
    "WITH " + prints_ctes() + ",\n" + _REPS + ",\n" + MATCHED_CTES + """
SELECT a_id, b_id, printf('Matched %d of %d nodes (%.2f%%) against %d of %d nodes (%.2f%%)', matched, total_a, pct_a,
                          matched, total_b, pct_b) AS report FROM matches""",
)
def q_c12(spark, sf_dir):
    scored = SIM.with_decision(SIM.near_duplicate_pairs(doc_prints(spark, sf_dir)))
    return SIM.match_report(scored)


KEYS = ["frontend", "original_verifier", "parse_success"]


def j4_sql(agree: str = "0", ctes: str = "", joins: str = "", keep: str = "TRUE") -> str:
    """All documents against all that share a node: pairs of equal keys, the earlier in the later one's size band, that match;
    then pairs of the groups of copies (equal print, keys, loc and ``agree``) that they belong to."""
    return (
        "WITH " + ENTITIES + ",\n" + ctes + prints_ctes() + f""",
ep AS (SELECT p.*, e.loc, e.frontend, e.original_verifier, e.parse_success, {agree} AS agree FROM prints p
       JOIN entities e ON e.entity_id = p.doc_id {joins}),
grp AS (SELECT doc_id, CASE WHEN total = 0 THEN doc_id ELSE min(doc_id) OVER (
          PARTITION BY root_hash, frontend, original_verifier, parse_success, loc, agree, total = 0) END AS rep_id FROM ep),
pairs AS (
  SELECT DISTINCT a.doc_id AS a_id, b.doc_id AS b_id FROM tokens a JOIN tokens b ON a.h = b.h AND a.doc_id < b.doc_id
  JOIN ep ea ON ea.doc_id = a.doc_id JOIN ep eb ON eb.doc_id = b.doc_id
  WHERE ea.frontend = eb.frontend AND ea.original_verifier = eb.original_verifier
    AND ea.parse_success = eb.parse_success
    AND ea.loc BETWEEN CAST(trunc(eb.loc * 0.5) AS INTEGER) AND CAST(trunc(eb.loc * 2.0) AS INTEGER)),
"""
        + MATCHED_CTES
        + f""",
of_groups AS (
  SELECT least(ga.rep_id, gb.rep_id) AS a_id, greatest(ga.rep_id, gb.rep_id) AS b_id, matched,
         CASE WHEN ga.rep_id < gb.rep_id THEN total_a ELSE total_b END AS total_a,
         CASE WHEN ga.rep_id < gb.rep_id THEN total_b ELSE total_a END AS total_b
  FROM matches JOIN grp ga ON ga.doc_id = a_id JOIN grp gb ON gb.doc_id = b_id WHERE ga.rep_id <> gb.rep_id AND {keep})
SELECT DISTINCT a_id, b_id, matched, total_a, total_b FROM of_groups"""
    )


@query("J4_similar_candidates", j4_sql())
def q_j4(spark, sf_dir):
    """Pairs of copy groups; ``J4_copy_members`` has the groups' members."""
    return SIM.similar_groups(entity_prints(spark, sf_dir), KEYS, BAND)[0]


@query(
    "J4_copy_members",
    "WITH " + ENTITIES + ",\n" + prints_ctes() + """
SELECT * FROM (
  SELECT p.doc_id, min(p.doc_id) OVER w AS rep_id, count(*) OVER w AS n_copies FROM prints p JOIN entities e ON e.entity_id = p.doc_id
  WHERE p.total > 0 WINDOW w AS (PARTITION BY p.root_hash, e.frontend, e.original_verifier, e.parse_success, e.loc))
WHERE n_copies > 1""",
)
def q_j4m(spark, sf_dir):
    return SIM.copy_groups(entity_prints(spark, sf_dir), [*KEYS, "loc"]).where("n_copies > 1")


@query(
    "J5_print_candidates",
    "WITH " + ENTITIES + """
SELECT q.entity_id AS probe_id, e.entity_id FROM entities q JOIN entities e ON e.entity_id <> q.entity_id AND e.frontend = q.frontend
  AND e.original_verifier = q.original_verifier AND e.parse_success = q.parse_success
  AND e.loc BETWEEN CAST(trunc(q.loc * 0.5) AS INTEGER) AND CAST(trunc(q.loc * 2.0) AS INTEGER)
WHERE q.entity_id % 100 = 0""",
)
def q_j5(spark, sf_dir):
    """For every document whose id is divisible by 100: the stored entities that may be similar to it whatever the results say
    (equal keys, size band), as an answer of its own."""
    e = T.entities(spark, sf_dir).select("entity_id", "loc", *KEYS)
    return LK.print_candidates(e.where(F.col("entity_id") % 100 == 0), e, KEYS, BAND)


@query(
    "J8_exists_similar",
    "WITH "
    + prints_ctes("documents")
    + ",\n"
    + prints_ctes("benchmark", "item_id", prefix="q_")
    + """,
all_kids AS (SELECT * FROM q_line_kids UNION SELECT * FROM line_kids),
pairs AS (SELECT DISTINCT a.doc_id AS a_id, b.doc_id AS b_id FROM q_tokens a JOIN tokens b ON a.h = b.h),
"""
    + matched_ctes(a="q_", b="", kids="all_kids")
    + "\nSELECT DISTINCT a_id AS doc_id FROM matches",
)
def q_j8(spark, sf_dir):
    probe = FP.document_prints(T.read(spark, sf_dir, "benchmark"), id_col="item_id")
    return SIM.exists_similar(probe, doc_prints(spark, sf_dir))


def admission_sql(prints: str, ids: str, conditions: str = "TRUE", direct: str = "TRUE", ctes: str = "", keep: str = "TRUE") -> str:
    """DuckDB: one-by-one admission. All pairs that share a node and meet ``conditions`` (aliases ea: earlier, eb: later)
    are compared by brute force; ``direct`` is the later item's rule; the items are then walked in order of ids with
    the list of those rejected so far."""
    return (
        "WITH RECURSIVE " + ctes + prints + f""",
ep AS ({ids}),
pairs AS (
  SELECT DISTINCT a.doc_id AS a_id, b.doc_id AS b_id FROM tokens a JOIN tokens b ON a.h = b.h AND a.doc_id < b.doc_id
  JOIN ep ea ON ea.doc_id = a.doc_id JOIN ep eb ON eb.doc_id = b.doc_id WHERE {conditions}),
"""
        + MATCHED_CTES
        + f""",
edges AS (
  SELECT a_id, b_id FROM decided JOIN ep eb ON eb.doc_id = b_id
  WHERE (({direct} AND pct_a >= 70.0 AND pct_b >= 70.0) OR pct_a >= 99.0 OR pct_b >= 99.0) AND {keep}),
nb AS (SELECT b_id AS id, list(a_id) AS es, row_number() OVER (ORDER BY b_id) AS rn FROM edges GROUP BY b_id),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, []::BIGINT[] AS rej
  UNION ALL
  SELECT nb.rn, CASE WHEN list_has_all(w.rej, nb.es) THEN w.rej ELSE list_append(w.rej, nb.id) END
  FROM walk w JOIN nb ON nb.rn = w.rn + 1)
SELECT doc_id, NOT list_contains((SELECT arg_max(rej, rn) FROM walk), doc_id) AS accepted FROM ep"""
    )


ENTITY_IDS = ("SELECT p.doc_id, e.loc, e.frontend, e.original_verifier, e.parse_success FROM prints p JOIN entities e "
              "ON e.entity_id = p.doc_id")
SAME_KEYS_IN_BAND = ("ea.frontend = eb.frontend AND ea.original_verifier = eb.original_verifier AND ea.parse_success = eb.parse_success "
                     "AND ea.loc BETWEEN CAST(trunc(eb.loc * 0.5) AS INTEGER) AND CAST(trunc(eb.loc * 2.0) AS INTEGER)")
DIRECT_SQL = "eb.frontend IN (" + ", ".join(f"'{f}'" for f in DIRECT_FRONTENDS) + ")"

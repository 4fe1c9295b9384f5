"""Registered queries ``opN_<name>`` of this subpackage: each applies its operator, with production parameters, to its
whole table. SQL is for DuckDB on the same tables; where SQL cannot state a method, tests hold the query against a
brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import (decontam, divergence, language_id, license_scan, line_dedup, mixing, pii, quality, secret_scan, simhash,
                        spelling, url_filter, wavelet)
from vellum.llm.common import documents

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


@register("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = simhash.near_duplicates(documents(spark, sf_dir))
    return v.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def word_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, documents(spark, sf_dir))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = wavelet.scratch_folder(spark)
    wavelet.write_shards(docs, word_tokenizer(), folder)
    return wavelet.read_shards(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = secret_scan.secret_spans(documents(spark, sf_dir))
    base = F.concat(*[secret_scan.tagged(k) for k in secret_scan.KINDS])
    return v.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.concat(base, secret_scan.random_tagged())).alias("spans"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register("op4_line_dedup", f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(l, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_dedup.line_report(documents(spark, sf_dir))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


@register("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds."""
    return decontam.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("k_text")


def captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``: the fetch time is derived from page_id, spread over the year 2024."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        days=(F.col("page_id") * 7919 % 366).cast("int"), secs=(F.col("page_id") * 104729 % 86400).cast("decimal(18,6)"))
    return pages.select("page_id", "url", at.alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the hosts of ``pages``: hosts and domains by their first page, each added,
    removed 40 days later and added again after 90 more."""
    h = pages.select(url_filter.host(F.col("url")).alias("h"), "page_id").where("h IS NOT NULL")
    def first(key: Column) -> DataFrame:
        return h.select(key.alias("pattern"), "page_id").groupBy("pattern").agg(F.min("page_id").alias("m"))
    hosts = first(F.col("h")).where("m % 3 = 0").withColumn("list", F.when(F.col("m") % 2 == 0, "adult").otherwise("spam"))
    parent = F.substring_index("h", ".", -3)
    parents = first(parent).where("m % 4 = 1").withColumn("list", F.lit("ads"))
    e = hosts.unionByName(parents)
    day = lambda n: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("m") % 200 + n).cast("int"))
    change = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    e = e.select("list", "pattern", F.explode(F.array(change("add", 0), change("remove", 40), change("add", 130))).alias("c"))
    return e.select("list", "pattern", "c.action", "c.at")


@register("op7_url_filter", r"""
WITH p AS (SELECT DISTINCT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)', 1)), '\.$', '') AS h,
             TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 366 AS INTEGER)) + to_seconds(page_id * 104729 % 86400) AS fetched_at FROM pages),
x AS (SELECT h AS pattern, min(page_id) AS m, 'h' AS k FROM p WHERE h <> '' GROUP BY 1
      UNION ALL SELECT array_to_string(list_slice(string_split(h, '.'), -3, -1), '.'), min(page_id), 'd' FROM p WHERE h <> '' GROUP BY 1),
l AS (SELECT pattern, m, CASE WHEN k = 'd' THEN 'ads' WHEN m % 2 = 0 THEN 'adult' ELSE 'spam' END AS list
      FROM x WHERE (k = 'h' AND m % 3 = 0) OR (k = 'd' AND m % 4 = 1)),
e AS (SELECT list, pattern, a.action, TIMESTAMP '2024-01-01' + to_days(CAST(m % 200 + a.n AS INTEGER)) AS changed
      FROM l, (VALUES ('add', 0), ('remove', 40), ('add', 130)) a(action, n)),
i AS (SELECT list, pattern, action, changed AS since,
             coalesce(lead(changed) OVER (PARTITION BY list, pattern ORDER BY changed), TIMESTAMP '9999-12-31') AS until FROM e),
hit AS (SELECT p.page_id, p.url, i.list, i.pattern, i.since FROM p JOIN i
        ON (p.h = i.pattern OR (ends_with(p.h, '.' || i.pattern) AND NOT regexp_matches(p.h, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$'))) AND i.action = 'add' AND i.since <= p.fetched_at AND p.fetched_at < i.until),
f AS (SELECT page_id, url, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
             max({n: length(pattern), p: pattern, s: since}) AS best FROM hit GROUP BY 1, 2)
SELECT p.page_id, p.url, p.fetched_at, f.n IS NOT NULL AS blocked, coalesce(f.n, 0) AS n_entries, coalesce(f.lists, '') AS lists,
       f.best.p AS pattern, f.best.s AS listed_since FROM p LEFT JOIN f USING (page_id, url)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    return url_filter.filter_captures(captures(pages), list_entries(pages))


@register("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.quality_verdicts(documents(spark, sf_dir))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@register("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@register("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs found to be licences."""
    return license_scan.scan(documents(spark, sf_dir))


@register("op11_divergence", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS n_terms, sum(total) AS total FROM k GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n, coalesce(any_value(v.n_terms), 0) AS n_terms, any_value(v.total) AS total
      FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON d.lang = v.lang
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s ON d.lang = s.lang AND d.source = s.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.n_terms) AS p,
             1 + (1000000000::HUGEINT * (k.total + 5)) // (g.total + 5 * g.n_terms) AS q
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
      AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
x AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
             CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def _tagged(kind: Column, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed in ``pii.KINDS``, then start; comma-joined."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, pii.KINDS)), kind)
    order = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x["kind"]).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


@register("op12_pii")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pii.private_spans(documents(spark, sf_dir))
    base = F.concat(*[_tagged(F.lit(k), F.col(k)) for k in pii.KINDS])
    return v.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS], F.sha2(_listed(base), 256).alias("base_sha256"),
                    _listed(F.concat(base, "added")).alias("spans"))


@register("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir)))

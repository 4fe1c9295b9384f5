"""Reading the input tables and mapping them onto the logical tables of the corpus service.

Logical tables (see README):
  entities        accepted corpus items      <- documents
  submissions     intake queue               <- benchmark (texts), events (arrival order)
  results         runs of two back ends      <- orders (+ lineitem error ids) as "symbolic", events as "vcgen"
  feature_entries feature values             <- lineitem / events / customer
  label_features  constant features          <- labels

Every adapter is a lazy projection over a parquet scan, so column pruning and filter pushdown
reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.scalars import loc
from vellum.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# Fixed origin for derived submission dates (arrival order of documents / benchmark items).
ENTITY_EPOCH = "2024-01-01 00:00:00"
SUBMISSION_EPOCH = "2025-01-01 00:00:00"

ERROR_TYPE = "array<struct<error_id:string,message:string>>"
PHASE_TYPE = "array<struct<phase:string,millis:bigint>>"


# Tables whose rows carry long texts: per-row work on them is CPU-heavy, so their scans are spread over
# all cores when the files give too few partitions (see ``vellum.session.spread``).
TEXT_TABLES = {"documents", "benchmark", "pages", "conversations"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _epoch_plus_seconds(epoch: str, secs: Column) -> Column:
    return F.lit(epoch).cast("timestamp_ntz") + F.make_dt_interval(secs=secs)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted corpus (ProgramEntries) from ``documents``.

    entity_id=doc_id, program=text, loc=C1(text), frontend=source, original_verifier=lang,
    original_runtime=n_chars, parse_success = more than one line, submission_date = epoch + doc_id s.
    """
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("entity_id"),
        _epoch_plus_seconds(ENTITY_EPOCH, F.col("doc_id")).alias("submission_date"),
        F.col("text").alias("program"),
        loc("text").alias("loc"),
        F.col("source").alias("frontend"),
        F.col("lang").alias("original_verifier"),
        F.array().cast("array<string>").alias("args"),
        F.col("n_chars").alias("original_runtime"),
        (loc("text") > 1).alias("parse_success"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake queue (UserSubmissions) from ``benchmark``."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("submission_id"),
        _epoch_plus_seconds(SUBMISSION_EPOCH, F.col("item_id")).alias("submission_date"),
        F.col("text").alias("program"),
        loc("text").alias("loc"),
        F.lit("Generic").alias("frontend"),
        F.array(F.lit("--timeout"), F.lit("10")).alias("args"),
        F.lit("symbolic").alias("original_verifier"),
        F.lit(True).alias("success"),
        F.lit(1500).cast("bigint").alias("runtime"),
    )


def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake queue from ``events``: one submission per event, arrival = ts."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("submission_id"),
        F.col("ts").alias("submission_date"),
        F.col("props").alias("program"),
        loc("props").alias("loc"),
        F.col("event_type").alias("frontend"),
        F.array().cast("array<string>").alias("args"),
        F.lit("vcgen").alias("original_verifier"),
        (F.col("value") <= 100).alias("success"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("runtime"),
    )


def order_error_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: sorted distinct error ids ``l_returnflag || l_linestatus`` of its line items.

    The set per order is bounded by the distinct flag pairs, and ``collect_set`` combines map-side.
    """
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("result_id")).agg(
        F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("error_ids")
    )


def results_symbolic(spark: SparkSession, sf_dir: str, with_errors: bool = False) -> DataFrame:
    """Back end A results from ``orders``.

    success = status F, did_timeout = status P, runtime = floor(totalprice), version = orderpriority.
    With ``with_errors`` the error list comes from the order's line items ([] when it has none).
    """
    o = read(spark, sf_dir, "orders")
    base = o.select(
        F.col("o_orderkey").alias("result_id"),
        F.lit("symbolic").alias("backend"),
        F.col("o_orderdate").alias("creation_date"),
        F.col("o_orderpriority").alias("version_hash"),
        F.col("o_custkey").alias("entity_id"),
        (F.col("o_orderstatus") == "F").alias("success"),
        (F.col("o_orderstatus") == "P").alias("did_timeout"),
        F.floor("o_totalprice").cast("bigint").alias("runtime"),
    )
    if not with_errors:
        return base.withColumn("errors", F.array().cast(ERROR_TYPE)).withColumn(
            "phase_runtimes", F.array().cast(PHASE_TYPE)
        )
    err = order_error_ids(spark, sf_dir)
    return (
        base.join(err, "result_id", "left")
        .withColumn(
            "errors",
            F.transform(
                F.coalesce(F.col("error_ids"), F.array().cast("array<string>")),
                lambda x: F.struct(x.alias("error_id"), F.lit("").alias("message")),
            ).cast(ERROR_TYPE),
        )
        .drop("error_ids")
        .withColumn("phase_runtimes", F.array().cast(PHASE_TYPE))
    )


def results_vcgen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back end B results from ``events``.

    success = value <= 100, did_timeout = value > 300, runtime = floor(value * 100), version = event_type.
    """
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("result_id"),
        F.lit("vcgen").alias("backend"),
        F.col("ts").alias("creation_date"),
        F.col("event_type").alias("version_hash"),
        F.col("user_id").alias("entity_id"),
        (F.col("value") <= 100).alias("success"),
        (F.col("value") > 300).alias("did_timeout"),
        F.floor(F.col("value") * 100).cast("bigint").alias("runtime"),
        F.array().cast(ERROR_TYPE).alias("errors"),
        F.array().cast(PHASE_TYPE).alias("phase_runtimes"),
    )


def feature_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature values of three kinds (UNION ALL):

    symbolic: lineitem -> ('returnflag', l_orderkey, l_returnflag), ('linestatus', l_orderkey, l_linestatus)
    vcgen:    events   -> ('props_k', event_id, $.k of props)
    const:   customer -> ('segment', c_custkey, c_mktsegment)
    """
    li = read(spark, sf_dir, "lineitem")
    sil = li.select(
        F.col("l_orderkey").alias("ref_id"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    ).unpivot("ref_id", ["returnflag", "linestatus"], "feature_name", "value")
    sil = sil.select("feature_name", F.lit("symbolic").alias("ref_kind"), "ref_id", "value")
    ev = read(spark, sf_dir, "events").select(
        F.lit("props_k").alias("feature_name"),
        F.lit("vcgen").alias("ref_kind"),
        F.col("event_id").alias("ref_id"),
        F.get_json_object("props", "$.k").alias("value"),
    )
    cu = read(spark, sf_dir, "customer").select(
        F.lit("segment").alias("feature_name"),
        F.lit("const").alias("ref_kind"),
        F.col("c_custkey").alias("ref_id"),
        F.col("c_mktsegment").alias("value"),
    )
    return sil.unionByName(ev).unionByName(cu)


def label_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant features from ``labels``: (doc_id, 'quality' | 'toxic', value as text)."""
    lb = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("ref_id"),
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
    )
    return lb.unpivot("ref_id", ["quality", "toxic"], "feature_name", "value").select(
        "feature_name", F.lit("const").alias("ref_kind"), "ref_id", "value"
    )


def customer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities for the result-side operators, from ``customer`` (results_symbolic.entity_id = o_custkey).

    original_runtime = floor(|c_acctbal| * 1000) stands in for the first recorded run time.
    """
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_mktsegment").alias("frontend"),
        F.floor(F.abs(F.col("c_acctbal")) * 1000).cast("bigint").alias("original_runtime"),
    )

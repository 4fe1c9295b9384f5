"""File sources and sinks (S5, S11, S15, S16, P12): whole-file texts, JSON result files, parquet tables.

PostgreSQL users can point ``spark.read.jdbc`` at their tables and map them with the same column names;
nothing here needs a database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the Unicode replacement character that stands for undecodable bytes.
REPLACEMENT_CHAR = "\ufffd"


def read_program_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file ``(path, program)``: the whole file decoded as UTF-8 with malformed byte sequences
    dropped. They become U+FFFD, and texts that held any lose that character; texts of valid bytes are unchanged."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", decoded(F.col("content")).alias("program"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, malformed sequences dropped."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.regexp_replace(F.make_valid_utf8(s), REPLACEMENT_CHAR, ""))


CONTAINER_BYTES = 128 << 20


def write_text_container(df: DataFrame, path: str, id_col: str, text_col: str, container_bytes: int = CONTAINER_BYTES) -> None:
    """Many texts in few files: at most one for each ``container_bytes`` of text, ordered by id.

    The texts are kept byte for byte. Row groups are small and know the range of their ids, so a container is split over tasks
    and a look-up by id reads the groups that may hold it.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("content"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    ranges = rows.repartitionByRange(max(1, int(size // container_bytes)), "id").sortWithinPartitions("id")
    ranges.write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(path)


def read_text_container(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """``(id, content, program)`` of a container, of all texts or of some ids."""
    rows = spark.read.parquet(path)
    if ids is not None:
        rows = rows.where(F.col("id").isin([int(i) for i in ids]))
    return rows.select("id", "content", decoded(F.col("content")).alias("program"))


def write_json_results(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines (one object per row), optionally one folder per entity."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def read_json_results(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read JSON result files back (explicit schema recommended: no inference pass)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table."""
    df.write.mode("append").parquet(path)


def clear_table(spark: SparkSession, path: str) -> None:
    """Replace a parquet table by an empty one with the same schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

"""Session helpers: building a local session for tests/bench and resolving the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Set by :func:`local_session` alone: see :func:`spread`.
SPREAD_CONF = "spark.vellum.spreadSmallInputs"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vellum",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench run.

    On a cluster the session comes from the platform; none of the library code relies on these
    settings except ``spark.checkpoint.dir`` (see :func:`checkpoint_dir`). ``event_log_dir`` turns on Spark's
    event log (stage and task times) in a scratch folder; the web UI stays off.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(SPREAD_CONF, "true")
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a fresh scratch folder; on a cluster no machine-local folder will do, so a
    missing setting is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vellum-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read back: far smaller than a checkpoint, and only the columns asked for
    are read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop, each computed from the one before.

    A checkpoint cuts the lineage but keeps the size estimate, and joins multiply estimates: after some dozens of rounds
    planning alone takes minutes. Here each round is written as Parquet to the shared checkpoint folder and read back,
    so it has its real size. Two places take turns: a round reads one and overwrites the other, which no one needs any
    more. Use only the table returned last.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._base = f"{checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        self._turn = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self._turn = 1 - self._turn
        path = f"{self._base}/{self._turn}"
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """For tests and the bench, whose tables are single files of one row group: round-robin repartition when the
    input has fewer partitions than cores. Opt-in (``SPREAD_CONF``, set by :func:`local_session`); elsewhere the scan
    is left as it is, so no shuffle of texts is ever added."""
    spark = df.sparkSession
    if spark.conf.get(SPREAD_CONF, "false") != "true":
        return df
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access (e.g. Spark Connect): leave the plan as it is
        return df
    return df if have >= want else df.repartition(want)


def is_spread(df: DataFrame) -> bool:
    """A scan that gives every core a partition, so that its rows can be worked on where they are read."""
    spark = df.sparkSession
    if spark.conf.get(SPREAD_CONF, "false") == "true":
        return True
    try:
        return df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    except Exception:  # sessions without RDD access
        return False


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume (apply on the session builder).

    Shuffle partitions ~ input / 256 MB (at least 2 per core) so a shuffle partition fits comfortably in an
    executor's execution memory; AQE coalesces small ones and splits skewed ones (a key with a third of the rows
    is split across tasks at join time, on top of the map-side pre-aggregation the operators already do).
    """
    parts = max(2 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }

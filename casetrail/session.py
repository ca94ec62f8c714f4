"""Session settings and the shared folder for cut-off points in long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "local"
_local_folders: dict[str, str] = {}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "casetrail", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster without it is refused, because a
    folder on one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL not in _local_folders:
        _local_folders[_LOCAL] = tempfile.mkdtemp(prefix="casetrail-")
    return _local_folders[_LOCAL]


def stash(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one expensive aggregate feeds several small ones: the log is then scanned once instead of once per
    consumer, lost executors cannot force the whole plan to run again, and Spark knows the size of what it reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/casetrail/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Spread a small input over all cores before heavy work per row.

    A file of one row group or one unsplittable document is read by one task. Inputs too small to give every core a
    full read are redistributed; larger ones come in enough pieces and are left where they are.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    per_task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * per_task else rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark ``df`` for broadcasting when it has at most ``max_rows`` rows; beyond that leave the join to Spark."""
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df

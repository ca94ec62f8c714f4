"""The result tables of one engagement, as Parquet under one folder."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail import schema
from casetrail.operators.findings import findings, metrics
from casetrail.operators.register import latest

APPENDED = {"findings": schema.FINDINGS, "audit": schema.AUDIT}
REPLACED = {"entities": schema.ENTITIES, "metrics": schema.METRICS}


class Store:
    """Tables that are only ever appended to. Of the keyed ones, entities and metrics, a reader sees the last row of a key.

    Two writers at a time both add their rows, so neither can undo the other; :meth:`compact` drops rows nobody sees.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _rows(self, name: str) -> DataFrame:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REPLACED[name].fields)
        try:
            return self.spark.read.schema(f"{columns}, stored_at bigint, load_seq bigint").parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], f"{columns}, stored_at bigint, load_seq bigint")

    def read(self, name: str) -> DataFrame:
        if name not in REPLACED:
            return self.spark.read.parquet(f"{self.root}/{name}")
        ordered = self._rows(name).withColumn("_order", F.struct("stored_at", "load_seq")).drop("stored_at", "load_seq")
        return latest(ordered, "fqn", "_order").select(*REPLACED[name].fieldNames())

    def append(self, name: str, rows: DataFrame) -> None:
        if name in APPENDED:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in APPENDED[name].fields])
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Add or replace rows by key. ``rows`` may carry ``load_seq``; the last of a key wins."""
        seq = F.col("load_seq") if "load_seq" in rows.columns else F.lit(0)
        stamped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REPLACED[name].fields],
                              F.lit(time.time_ns()).cast("long").alias("stored_at"), seq.cast("long").alias("load_seq"))
        stamped.write.mode("append").parquet(f"{self.root}/{name}")

    def compact(self, name: str, target: "Store") -> None:
        """Write what a reader sees into another store."""
        target.upsert(name, self.read(name))

    def keep(self, detected: DataFrame) -> None:
        """Store a detector run: its metrics replace earlier ones, its findings are appended."""
        self.upsert("metrics", metrics(detected))
        self.append("findings", findings(detected))

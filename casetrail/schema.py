"""Table schemas at rest."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_LOG = T.StructType([
    T.StructField("ingest_seq", T.LongType(), False),
    T.StructField("case_id", T.StringType(), False),
    T.StructField("activity", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("resource", T.StringType(), False),
    T.StructField("source_system", T.StringType(), False),
    T.StructField("entity_fqn", T.StringType(), False),
])

ENTITIES = T.StructType([
    T.StructField("fqn", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("source_system", T.StringType(), False),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), True),
])

METRICS = T.StructType([
    T.StructField("fqn", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("evidence_json", T.StringType(), True),
])

FINDINGS = T.StructType([
    T.StructField("detector_order", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("severity", T.DoubleType(), False),
    T.StructField("frequency", T.DoubleType(), False),
    T.StructField("fixability", T.DoubleType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("evidence_fqn", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
])

ANSWER_KEY = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("detail", T.StringType(), True),
])

AUDIT = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("actor", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("target", T.StringType(), True),
    T.StructField("verb", T.StringType(), True),
    T.StructField("decision", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
])

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))

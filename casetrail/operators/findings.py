"""The shape shared by all detectors.

A detector returns *detections*: a finding together with the metric it cites. :func:`findings` and :func:`metrics`
are the two projections that get stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed

FINDING_COLUMNS = ["detector_order", "kind", "title", "key", "severity", "frequency", "fixability", "score",
                   "evidence_fqn", "confidence"]


def register_order() -> list[Column]:
    return [F.desc("score"), F.asc("detector_order"), F.asc("key")]


def score(frequency: Column, severity: Column, fixability: Column) -> Column:
    return F.round(frequency * severity * fixability, 4)


def metric_fqn(kind: Column, key: Column) -> Column:
    return F.concat_ws(".", F.lit("metric"), kind, key)


def detections(df: DataFrame, order: int, kind: str, frequency: Column, value: Column, evidence: Column,
               title: tuple[Column, ...] = (), key: Column | None = None, severity: Column | None = None) -> DataFrame:
    """Detections of one kind from rows that already passed the detector's rule. ``title`` fills the kind's title,
    ``evidence`` is a struct."""
    fixed_severity, fixability = fixed.DETECTOR_SCORES[kind]
    filled = [part.cast("string") for part in title]
    named = df.select(
        F.lit(order).alias("detector_order"), F.lit(kind).alias("kind"),
        F.format_string(fixed.DETECTOR_TITLES[kind], *filled).alias("title"),
        (F.lit(fixed.DETECTOR_KEYS[kind]) if key is None else key).alias("key"),
        (F.lit(fixed_severity) if severity is None else F.round(severity, 3)).cast("double").alias("severity"),
        F.round(frequency, 3).alias("frequency"), F.lit(fixability).cast("double").alias("fixability"),
        F.lit(fixed.METRIC_NAMES[kind]).alias("metric_name"), value.cast("double").alias("metric_value"),
        F.to_json(evidence).alias("evidence_json"))
    return named.withColumns({
        "score": score(F.col("frequency"), F.col("severity"), F.col("fixability")),
        "evidence_fqn": metric_fqn(F.col("kind"), F.col("key")),
        "confidence": F.lit(1.0),
    })


def assemble(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def findings(detected: DataFrame) -> DataFrame:
    return detected.select(*FINDING_COLUMNS)


def register(detected: DataFrame) -> DataFrame:
    """Findings in register order."""
    return findings(detected).orderBy(*register_order())


def metrics(detected: DataFrame) -> DataFrame:
    return detected.select(F.col("evidence_fqn").alias("fqn"), F.col("metric_name").alias("name"),
                           F.col("metric_value").alias("value"), "evidence_json")

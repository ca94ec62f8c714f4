"""Grading a register against a labelled key, baselines to compare with, and what the scrubber did."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail import fixed_values as fixed
from casetrail.operators.findings import FINDING_COLUMNS, score
from casetrail.operators.mining import EventLog, directly_follows
from casetrail.operators.register import normal_key, with_grounding
from casetrail.session import stash

# --- baselines ------------------------------------------------------------------------------------------------------


def _naive(df: DataFrame, kind: str, key: Column, frequency: Column) -> DataFrame:
    half = F.lit(0.5)
    return df.select(
        F.lit(0).alias("detector_order"), F.lit(kind).alias("kind"),
        F.format_string(fixed.NAIVE_TITLES[kind], key).alias("title"), key.alias("key"),
        half.alias("severity"), frequency.cast("double").alias("frequency"), half.alias("fixability"),
        score(frequency, half, half).alias("score"), F.coalesce("cite", F.lit("")).alias("evidence_fqn"),
        F.lit(1.0).alias("confidence")).select(*FINDING_COLUMNS)


def _first_fqn(events: DataFrame) -> Column:
    """The entity of the first recorded event that has one."""
    return events.where("entity_fqn <> ''").agg(
        F.min_by("entity_fqn", F.struct("case_id", "ingest_seq"))).scalar()


def naive_baseline(log: EventLog) -> DataFrame:
    """The most frequent activity called a bottleneck, and rework if it happens more than once per case on average."""
    named = F.when(F.col("entity_fqn") != "", F.struct("case_id", "ingest_seq"))
    per_activity = stash(log.events.groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("entity_fqn", named).alias("cite")))
    cases = log.events.agg(F.count_distinct("case_id")).scalar()
    most = per_activity.orderBy(F.desc("n"), "activity").limit(1)
    top = most.withColumns({"total": per_activity.agg(F.sum("n")).scalar(), "cases": cases})
    volume = _naive(top, "bottleneck", F.col("activity"), F.col("n") / F.col("total"))
    repeats = _naive(top.where("n / cases > 1"), "rework", F.col("activity"), F.lit(0.5))
    return volume.unionByName(repeats)


def naive_field_service_baseline(log: EventLog) -> DataFrame:
    """The most frequent step called a dispatch bottleneck."""
    top = directly_follows(log).orderBy(F.desc("n"), "src", "dst").limit(1)
    key = F.concat("src", F.lit("->"), "dst")
    return _naive(top.withColumn("cite", _first_fqn(log.events)), "dispatch-bottleneck", key, F.lit(0.5))


# --- scores ---------------------------------------------------------------------------------------------------------


def _deduplicated(rows: DataFrame, population: str) -> DataFrame:
    """One row per kind and key regardless of case and blanks, the first in register order."""
    order = F.struct((-F.col("score")).alias("s"), "detector_order", F.col("key").alias("k"), F.col("kind").alias("d"))
    return rows.groupBy(normal_key(F.col("kind")).alias("_kind"), normal_key(F.col("key")).alias("_key")).agg(
        F.min_by("kind", order).alias("kind")).select(F.lit(population).alias("population"), "kind", "_key")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def grade(rows: DataFrame, answers: DataFrame, *sources: DataFrame) -> DataFrame:
    """Two rows, ``population`` ungated and gated, with tp, fp, fn, precision, recall, f1, the number of findings and
    the share of findings whose citation does not resolve. The large sources are looked through once; the flagged
    findings, which are few, are stored for the rest."""
    return grade_flagged(stash(with_grounding(rows, *sources)), answers)


def grade_systems(systems: dict[str, DataFrame], answers: DataFrame, *sources: DataFrame) -> dict[str, DataFrame]:
    """:func:`grade` for several registers, which look through the sources together."""
    named = [rows.withColumn("_system", F.lit(name)) for name, rows in systems.items()]
    flagged = stash(with_grounding(reduce(DataFrame.unionByName, named), *sources))
    return {name: grade_flagged(flagged.where(F.col("_system") == name).drop("_system"), answers) for name in systems}


def grade_flagged(flagged: DataFrame, answers: DataFrame) -> DataFrame:
    """:func:`grade` of stored findings with ``grounded``."""
    counts = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("grounded")).alias("loose"))
    keys = answers.select("kind", normal_key(F.col("key")).alias("_key")).distinct().withColumn("known", F.lit(True))
    total = answers.agg(F.count(F.lit(1))).scalar()
    unique = _deduplicated(flagged, "ungated").unionByName(_deduplicated(flagged.where("grounded"), "gated"))
    both = flagged.sparkSession.createDataFrame([("ungated",), ("gated",)], "population string")
    matched = unique.join(keys, ["kind", "_key"], "left").groupBy("population").agg(
        F.count_if(F.col("known")).alias("tp"), F.count_if(F.col("known").isNull()).alias("fp"))
    table = both.join(matched, "population", "left").select(
        "population", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"))
    table = table.withColumn("fn", total - F.col("tp"))
    table = table.withColumn("p", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    table = table.withColumn("r", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return table.select(
        "population", "tp", "fp", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"),
        F.round(f1, 4).alias("f1"), counts.select("n").scalar().alias("n_findings"),
        F.round(_ratio(counts.select("loose").scalar(), counts.select("n").scalar()), 4).alias("hallucination_rate"))


def relative_error_reduction(ours: Column, baseline: Column) -> Column:
    return F.when(baseline >= 1, F.lit(0.0)).otherwise(F.round((ours - baseline) / (1 - baseline), 4))


def compare(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two graded systems side by side, per population."""
    other = baseline.select("population", F.col("f1").alias("baseline_f1"))
    return ours.select("population", "f1").join(other, "population").select(
        "population", "f1", "baseline_f1",
        relative_error_reduction(F.col("f1"), F.col("baseline_f1")).alias("rel_error_reduction"),
        F.round(F.col("f1") - F.col("baseline_f1"), 4).alias("abs_f1_delta"))


# --- leak check -----------------------------------------------------------------------------------------------------


def leak_check(rows: DataFrame, secrets: list[str]) -> DataFrame:
    """Occurrences of planted strings per text column: ``column_name, n_rows, n_leaks``."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    planted = F.array(*[F.lit(s) for s in secrets])

    def leaks(column: str) -> Column:
        return F.count_if(F.exists(planted, lambda s: F.contains(F.col(column), s)))

    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[leaks(c).alias(f"_{i}") for i, c in enumerate(texts)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"_{i}").alias("n_leaks"))
                        for i, c in enumerate(texts)])
    return counts.select(F.inline(entries))

"""Generic detectors. They read :func:`casetrail.operators.mining.log_facts`, preferably stored with ``stash``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.operators.findings import assemble, detections
from casetrail.operators.mining import ACTIVITY, BAD_CASE, STEP, TOTAL, durations, of_kind
from casetrail.operators.quantiles import median


def case_total(facts: DataFrame) -> Column:
    return F.coalesce(of_kind(facts, TOTAL).select("n").scalar(), F.lit(0))


def slow_steps(facts: DataFrame, factor: float = fixed.BOTTLENECK_FACTOR, within: list[str] | None = None,
               keep: int | None = None) -> DataFrame:
    """Steps whose mean time is at least ``factor`` times the median of the means; with ``keep`` the slowest of them.

    ``within`` restricts the candidates (and the median) to steps between those activities; the frequency is always
    over the steps of all cases.
    """
    timed = durations(facts)
    if within is not None:
        timed = timed.where(F.col("src").isin(within) & F.col("dst").isin(within))
    middle = median(timed, "mean_s") or 1.0
    most = F.coalesce(F.nullif(timed.agg(F.max("mean_s")).scalar(), F.lit(0.0)), F.lit(1.0))
    steps = of_kind(facts, STEP).select("src", "dst", F.col("n").alias("n_steps"))
    total = steps.agg(F.sum("n_steps")).scalar()
    slow = timed.where(F.col("mean_s") >= factor * middle)
    if keep is not None:
        slow = slow.orderBy(F.desc("mean_s"), "src", "dst").limit(keep)
    return (
        slow.join(steps, ["src", "dst"], "left")
        .select("src", "dst", "mean_s", (F.col("mean_s") / most).alias("severity"),
                F.coalesce("n_steps", F.lit(0)).alias("n_steps"))
        .withColumn("frequency", F.col("n_steps") / total))


def bottlenecks(facts: DataFrame, factor: float = fixed.BOTTLENECK_FACTOR, kind: str = "bottleneck", order: int = 1,
                within: list[str] | None = None, keep: int | None = None) -> DataFrame:
    """Findings of the slow steps; :data:`casetrail.fixed_values.BOTTLENECK_KEEP` is the usual ``keep`` of a short report."""
    key = F.concat("src", F.lit("->"), "dst")
    return detections(
        slow_steps(facts, factor, within, keep), order, kind, F.col("frequency"), F.col("mean_s"),
        F.struct(key.alias("transition"), F.col("n_steps").alias("n")), (key,), key, F.col("severity"))


def rework_findings(facts: DataFrame, at_least: float = fixed.REWORK_SHARE) -> DataFrame:
    share = F.col("n_repeat") / case_total(facts)
    rows = of_kind(facts, ACTIVITY).withColumn("share", share).where(F.col("share") >= at_least)
    activity = F.col("src")
    return detections(rows.where("n_repeat > 0"), 2, "rework", F.col("share"), F.col("n_repeat"),
                      F.struct(activity.alias("activity")), (activity,), activity)


def control_gaps(facts: DataFrame) -> DataFrame:
    rows = of_kind(facts, ACTIVITY).withColumn("coverage", F.col("n_cases") / case_total(facts))
    rows = rows.where((F.col("coverage") >= fixed.CONTROL_GAP_LOW) & (F.col("coverage") < fixed.CONTROL_GAP_HIGH))
    activity, skipped = F.col("src"), 1 - F.col("coverage")
    percent = F.round(skipped * 100, 0).cast("long")
    return detections(rows, 3, "control-gap", skipped, F.col("coverage"), F.struct(activity.alias("activity")),
                      (activity, percent), activity)


def recording_error_finding(facts: DataFrame, order: int = 4, cases_shown: int = fixed.EVIDENCE_CASES) -> DataFrame:
    """One finding when any case goes back in time. Its metric counts all cases, its evidence names the first of them."""
    total = of_kind(facts, TOTAL).where("n_cases > 0")
    first = of_kind(facts, BAD_CASE).select("src").orderBy("src").limit(cases_shown)
    cases = first.agg(F.array_sort(F.collect_list("src"))).scalar()
    return detections(total, order, "recording-error", F.col("n_cases") / F.col("n"), F.col("n_cases"),
                      F.struct(cases.alias("cases")))


def detect(facts: DataFrame, factor: float = fixed.BOTTLENECK_FACTOR) -> DataFrame:
    """All generic detections of a log."""
    return assemble([bottlenecks(facts, factor), rework_findings(facts), control_gaps(facts),
                     recording_error_finding(facts)])

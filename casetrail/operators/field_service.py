"""Detectors for field-service logs (quote, approve, schedule, attend, complete, invoice, rectify, service)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.operators.findings import assemble, detections
from casetrail.operators.generic import bottlenecks, recording_error_finding
from casetrail.operators.mining import CASE, TOTAL, CaseMeasures, EventLog, of_kind, record

FINANCE, FIELD = "finance", "fsm"
DAY_US = 86_400 * 1_000_000


def _flags() -> dict[str, Column]:
    """What happened in a case, as aggregates over its events."""
    def has(condition: Column) -> Column:
        return F.max(F.when(condition, 1).otherwise(0))

    def ran(activity: str) -> Column:
        return F.col("activity") == activity

    return {
        "completed": has(ran("JobComplete")), "invoiced": has(ran("Invoice")), "approved": has(ran("QuoteApproved")),
        "defect": has(ran("DefectRaised")), "rectified": has(ran("RectifyComplete")),
        "visits": F.count_if(ran("Attended")),
        "billed": has(F.col("activity").isin("Invoice", "Paid") & (F.col("source_system") == FINANCE)),
        "delivered": has(ran("JobComplete") & (F.col("source_system") == FIELD)),
        "quoter": _first_resource("Quote"), "approver": _first_resource("QuoteApproved"),
        "latest_us": F.max(F.unix_micros("ts"))}


def case_flags(log: EventLog) -> DataFrame:
    """One row per case with what happened in it. All aggregates combine map-side, so no case is ever gathered."""
    return log.events.groupBy(CASE).agg(*[flag.alias(name) for name, flag in _flags().items()])


def _first_resource(activity: str) -> Column:
    """Who is recorded first with an activity."""
    return F.min_by(F.when(F.col("activity") == activity, F.col("resource")),
                    F.when(F.col("activity") == activity, F.col("ingest_seq")))


def _same_person() -> Column:
    return F.coalesce((F.col("quoter") == F.col("approver")) & (F.col("quoter") != ""), F.lit(False))


def _counted() -> dict[str, Column]:
    """The numerators and denominators of the case-level detectors, as conditions on a case's flags."""
    yes = {c: F.col(c) == 1 for c in ("completed", "invoiced", "approved", "defect", "rectified", "billed", "delivered")}
    return {
        "completed": yes["completed"], "unbilled": yes["completed"] & ~yes["invoiced"],
        "defects": yes["defect"], "stalled": yes["defect"] & ~yes["rectified"],
        "invoiced": yes["invoiced"], "no_approval": yes["invoiced"] & ~yes["approved"],
        "repeat_visits": F.col("visits") > 1, "billed": yes["billed"], "orphans": yes["billed"] & ~yes["delivered"],
        "self_approved": _same_person()}


def case_counts(log: EventLog) -> DataFrame:
    """One row with the numerators and denominators of the case-level detectors, and the latest time in the log."""
    return case_flags(log).agg(
        F.count(F.lit(1)).alias("n_cases"), *[F.count_if(condition).alias(name) for name, condition in _counted().items()],
        F.max("latest_us").alias("latest_us"))


# kinds of rows in :func:`casetrail.operators.mining.log_facts`
CASES_WITH, LATEST, SERVICE = "cases_with", "latest", "service"


class JobMeasures(CaseMeasures):
    """Case counts, the latest time and the services of assets, taken from the same pass over the log as its steps."""

    columns = ["activity", "ts", "resource", "source_system", "entity_fqn"]

    @property
    def flags(self) -> dict[str, Column]:
        return _flags()

    def of_event(self) -> list[Column]:
        service = (F.col("activity") == "RoutineService") & (F.col("entity_fqn") != "")
        return [F.when(service, record(SERVICE, F.col("entity_fqn"), at_us=F.unix_micros("ts")))]

    def of_case(self) -> list[Column]:
        return [*[F.when(condition, record(CASES_WITH, F.lit(name))) for name, condition in _counted().items()],
                record(LATEST, F.lit(""), at_us=F.col("latest_us"))]


def counts_of(facts: DataFrame) -> DataFrame:
    """:func:`case_counts` from facts with :class:`JobMeasures`."""
    def of(kind: str, src: str, column: str, how: Callable[[Column], Column]) -> Column:
        return how(F.when((F.col("kind") == kind) & (F.col("src") == src), F.col(column)))

    sums = [F.coalesce(of(CASES_WITH, name, "n", F.sum), F.lit(0)).alias(name) for name in _counted()]
    return facts.where(F.col("kind").isin(TOTAL, CASES_WITH, LATEST)).agg(
        F.coalesce(of(TOTAL, "", "n", F.sum), F.lit(0)).alias("n_cases"), *sums, of(LATEST, "", "at_us", F.max).alias("latest_us"))


def services_of(facts: DataFrame, review: Column) -> DataFrame:
    """:func:`asset_services` from facts with :class:`JobMeasures`."""
    return _overdue(of_kind(facts, SERVICE).select(F.col("src").alias("entity_fqn"), F.col("at_us").alias("last_us")), review)


def same_person_cases(log: EventLog) -> DataFrame:
    """Cases whose first quote and first approval were recorded by the same, named resource."""
    first = log.events.where(F.col("activity").isin("Quote", "QuoteApproved")).groupBy(CASE).agg(
        _first_resource("Quote").alias("quoter"), _first_resource("QuoteApproved").alias("approver"))
    return first.where(_same_person())


def cross_source_orphans(log: EventLog) -> DataFrame:
    """Cases billed in finance that field service never completed."""
    billed = log.events.where(F.col("activity").isin("Invoice", "Paid") & (F.col("source_system") == FINANCE))
    done = log.events.where((F.col("activity") == "JobComplete") & (F.col("source_system") == FIELD))
    return billed.select(CASE).distinct().join(done.select(CASE).distinct(), CASE, "left_anti")


def asset_services(log: EventLog, review: Column | None = None) -> DataFrame:
    """Last routine service per asset and whether it is overdue at ``review``, the latest time in the log."""
    if review is None:
        review = log.events.agg(F.max(F.unix_micros("ts"))).scalar()
    services = log.events.where("activity = 'RoutineService' and entity_fqn <> ''")
    return _overdue(services.groupBy("entity_fqn").agg(F.max(F.unix_micros("ts")).alias("last_us")), review)


def _overdue(last: DataFrame, review: Column) -> DataFrame:
    allowed = (fixed.COMPLIANCE_INTERVAL_DAYS + fixed.COMPLIANCE_GRACE_DAYS) * DAY_US
    last = last.withColumn("last_us", F.greatest("last_us", F.lit(0)))
    return last.withColumn("overdue", review - F.col("last_us") > allowed)


def asset_counts(services: DataFrame) -> DataFrame:
    return services.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("overdue")).alias("overdue"))


def _rate(counts: DataFrame, order: int, kind: str, part: str, whole: str, above: float, evidence: Column | None = None
          ) -> DataFrame:
    """A detection when ``part`` exceeds the share ``above`` of ``whole``."""
    rate = F.col(part) / F.nullif(F.col(whole), F.lit(0))
    rows = counts.withColumn("rate", rate).where(F.col("rate") > above)
    return detections(rows, order, kind, F.col("rate"), F.col(part),
                      F.struct(whole, part) if evidence is None else evidence, (F.col(part),))


def unbilled_completion(counts: DataFrame) -> DataFrame:
    return _rate(counts, 1, "unbilled-completion", "unbilled", "completed", fixed.RATE_FLOOR)


def rectification_stall(counts: DataFrame) -> DataFrame:
    return _rate(counts, 2, "rectification-stall", "stalled", "defects", fixed.RATE_FLOOR)


def compliance_overdue(assets: DataFrame) -> DataFrame:
    evidence = F.struct(F.col("assets").alias("assets_with_service"), F.col("overdue"),
                        F.lit(fixed.COMPLIANCE_INTERVAL_DAYS).alias("interval_days"))
    return _rate(assets, 3, "compliance-overdue", "overdue", "assets", 0.0, evidence)


def approval_gap(counts: DataFrame) -> DataFrame:
    return _rate(counts, 4, "approval-gap", "no_approval", "invoiced", fixed.RATE_FLOOR)


def rework_loop(counts: DataFrame) -> DataFrame:
    return _rate(counts, 5, "rework-loop", "repeat_visits", "n_cases", fixed.RATE_FLOOR,
                 F.struct(F.lit("Attended").alias("activity")))


def dispatch_bottleneck(facts: DataFrame, factor: float = fixed.BOTTLENECK_FACTOR) -> DataFrame:
    return bottlenecks(facts, factor, "dispatch-bottleneck", 6, fixed.JOB_FLOW)


def segregation_of_duties(counts: DataFrame) -> DataFrame:
    return _rate(counts.withColumnRenamed("self_approved", "jobs"), 7, "segregation-of-duties", "jobs", "n_cases",
                 fixed.SMALL_RATE_FLOOR, F.struct("jobs"))


def cross_source_orphan(counts: DataFrame) -> DataFrame:
    return _rate(counts, 8, "cross-source-orphan", "orphans", "billed", fixed.SMALL_RATE_FLOOR)


def recording_error(facts: DataFrame) -> DataFrame:
    return recording_error_finding(facts, order=9)


def detect(facts: DataFrame, factor: float = fixed.BOTTLENECK_FACTOR) -> DataFrame:
    """All field-service detections from facts with :class:`JobMeasures`, best stored with ``stash``."""
    counts = counts_of(facts)
    return assemble([
        unbilled_completion(counts), rectification_stall(counts),
        compliance_overdue(asset_counts(services_of(facts, counts.select("latest_us").scalar()))),
        approval_gap(counts), rework_loop(counts), dispatch_bottleneck(facts, factor),
        segregation_of_duties(counts), cross_source_orphan(counts), recording_error(facts),
    ])

"""Process mining over an event log.

Two orders matter. *Recorded order* (``ingest_seq``) decides timing and recording errors; *time order*
(``ts``, then ``ingest_seq``) decides what follows what. Timings are kept as whole microseconds until the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.operators.ordering import (
    Grouped,
    dealt,
    digest_text,
    long_group_rows,
    order_free_digest,
    with_next,
    with_position,
)

CASE = "case_id"
TIME_ORDER = ["ts", "ingest_seq"]
RECORDED_ORDER = ["ingest_seq"]


class EventLog(Grouped):
    """An event log whose long cases are handled in pieces, and whose other cases are dealt to as many tasks as the log is long.

    ``most_events`` may be given when the caller can bound the number of events more cheaply than by counting ``events``.
    """

    def __init__(self, events: DataFrame, long_cases: list | None = None, most_events: int | None = None):
        super().__init__(events, CASE, long_cases)
        if most_events is not None:
            self.most_events = most_events

    @property
    def events(self) -> DataFrame:
        return self.rows

    @cached_property
    def most_events(self) -> int:
        return self.rows.count()

    def each(self, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        return super().each(lambda events, is_long: work(events if is_long else dealt(events, CASE, self.most_events), is_long))


# --- counts ---------------------------------------------------------------------------------------------------------


def activity_frequency(log: EventLog) -> DataFrame:
    """Events per activity."""
    return log.events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def case_activity(log: EventLog) -> DataFrame:
    """How often each case runs each activity."""
    return log.events.groupBy(CASE, "activity").agg(F.count(F.lit(1)).alias("n"))


def rework(log: EventLog) -> DataFrame:
    """Cases that run an activity more than once, per activity."""
    return case_activity(log).where("n > 1").groupBy("activity").agg(F.count(F.lit(1)).alias("n_cases"))


def case_count(log: EventLog) -> DataFrame:
    return log.events.agg(F.count_distinct(CASE).alias("n_cases"))


def coverage(log: EventLog) -> DataFrame:
    """Share of cases that contain each activity."""
    # the activities of each case, and once NULL for the case itself: one pass counts both
    ran = log.events.groupBy(CASE).agg(F.collect_set("activity").alias("ran"))
    each = ran.select(F.explode(F.concat("ran", F.array(F.lit(None).cast("string")))).alias("activity"))
    counted = each.groupBy("activity").agg(F.count(F.lit(1)).alias("n_cases"))
    total = F.max(F.when(F.col("activity").isNull(), F.col("n_cases"))).over(Window.partitionBy())
    return (counted.withColumn("total_cases", total).where("activity is not null")
            .withColumn("coverage", F.col("n_cases") / F.col("total_cases")))


def throughput(log: EventLog) -> DataFrame:
    """Time from the first to the last event of each case."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return log.events.groupBy(CASE).agg(span.alias("throughput_us"))


# --- what follows what ----------------------------------------------------------------------------------------------


def followed_by(log: EventLog) -> DataFrame:
    """One row per directly-follows step, in time order: ``case_id, src, dst``."""

    def steps(events: DataFrame, is_long: bool) -> DataFrame:
        narrow = events.select(CASE, "activity", *TIME_ORDER)
        nexts = with_next(narrow, CASE, TIME_ORDER, {"dst": "activity"}, is_long)
        return nexts.where("dst is not null").select(CASE, F.col("activity").alias("src"), "dst")

    return log.each(steps)


def directly_follows(log: EventLog) -> DataFrame:
    """Directly-follows graph: ``src, dst, n``."""
    return followed_by(log).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def selfloops(log: EventLog) -> DataFrame:
    return directly_follows(log).where("src = dst").select(F.col("src").alias("activity"), "n")


def _recorded_steps(events: DataFrame, is_long: bool) -> DataFrame:
    """Steps in recorded order with their gap; a negative gap is a recording error."""
    narrow = events.select(CASE, "activity", F.unix_micros("ts").alias("us"), *RECORDED_ORDER)
    nexts = with_next(narrow, CASE, RECORDED_ORDER, {"dst": "activity", "next_us": "us"}, is_long)
    gap = F.col("next_us") - F.col("us")
    return nexts.where("dst is not null").select(CASE, F.col("activity").alias("src"), "dst", gap.alias("gap_us"))


def recording_errors(log: EventLog) -> DataFrame:
    """Cases with timestamps that go back in recorded order, and how often."""
    steps = log.each(_recorded_steps)
    return steps.where("gap_us < 0").groupBy(CASE).agg(F.count(F.lit(1)).alias("n_errors"))


def _clean_case_steps(events: DataFrame, is_long: bool) -> DataFrame:
    """Recorded-order steps summed per case, only of cases without a recording error.

    The steps are summed per case first, so the window that looks at the whole case sees one row per distinct step.
    """
    per_case = _recorded_steps(events, is_long).groupBy(CASE, "src", "dst").agg(
        F.count(F.lit(1)).alias("n"),
        *micros_summed("gap_us"),
        F.count_if(F.col("gap_us") < 0).alias("errors"),
    )
    flagged = per_case.withColumn("case_errors", F.sum("errors").over(Window.partitionBy(CASE)))
    return flagged.where("case_errors = 0").select("src", "dst", "n", "_s", "_us")


def micros_summed(us: str) -> list[Column]:
    """Aggregates ``_s`` and ``_us``: the whole seconds and the rests of microseconds, summed apart.

    Microseconds of some ten million steps add up to more than a long holds; seconds and rests do not.
    """
    return [F.sum(F.expr(f"{us} div 1000000")).alias("_s"), F.sum(F.col(us) % 1_000_000).alias("_us")]


def micros_of_sums() -> Column:
    """Sum of ``_s`` and ``_us`` (see :func:`micros_summed`) over rows, in microseconds as an exact decimal."""
    return F.sum("_s").cast("decimal(20,0)") * F.lit(1_000_000) + F.sum("_us")


def mean_seconds(total_us: Column, n: Column) -> Column:
    return total_us.cast("double") / n / F.lit(1_000_000)


def transition_durations(log: EventLog) -> DataFrame:
    """Mean gap per step over cases without recording errors: ``src, dst, n, total_us`` (decimal), ``mean_s``."""
    summed = log.each(_clean_case_steps).groupBy("src", "dst").agg(
        F.sum("n").alias("n"), micros_of_sums().alias("total_us"))
    return summed.withColumn("mean_s", mean_seconds(F.col("total_us"), F.col("n")))


# --- variants -------------------------------------------------------------------------------------------------------


def _variant_per_case(log: EventLog) -> DataFrame:
    """``case_id, length, variant``: a digest of the activities and their positions, the same for cases of any length."""
    digests = order_free_digest(F.col("position"), F.col("activity"))

    def placed(events: DataFrame, is_long: bool) -> DataFrame:
        return with_position(events.select(CASE, "activity", *TIME_ORDER), CASE, TIME_ORDER, "position", is_long)

    per_case = log.each(placed).groupBy(CASE).agg(F.count(F.lit(1)).alias("length"), *digests)
    return per_case.select(CASE, "length", digest_text(F.col("length")).alias("variant"))


def variants(log: EventLog) -> DataFrame:
    """Cases per distinct activity sequence: ``variant, length, n_cases, example_case``.

    A variant is named by a digest, so that no sequence has to fit into one value; :func:`variant_steps` spells it out.
    """
    return _variant_per_case(log).groupBy("variant", "length").agg(
        F.count(F.lit(1)).alias("n_cases"), F.min(CASE).alias("example_case"))


def variant_steps(log: EventLog, chosen: DataFrame) -> DataFrame:
    """The sequence of each row of ``chosen`` (from :func:`variants`) as rows: ``variant, position, activity``."""
    wanted = chosen.select("variant", F.col("example_case").alias(CASE))

    def steps(events: DataFrame, is_long: bool) -> DataFrame:
        own = events.select(CASE, "activity", *TIME_ORDER).join(wanted, CASE)
        return with_position(own, CASE, TIME_ORDER, "position", is_long).select("variant", "position", "activity")

    return log.each(steps)


# --- conformance ----------------------------------------------------------------------------------------------------


def dfg_fitness(log: EventLog, reference: DataFrame) -> DataFrame:
    """Mean over cases of the share of steps found in ``reference`` (``src, dst``): one row, ``fitness``.

    A case's share is a sum over its steps, so every step is given the weight 1/steps-of-its-case and the weights are
    added up per distinct step before the reference is looked up. Cases without a step count as 1.
    """

    def weights(events: DataFrame, is_long: bool) -> DataFrame:
        narrow = events.select(CASE, "activity", *TIME_ORDER)
        nexts = with_next(narrow, CASE, TIME_ORDER, {"dst": "activity"}, is_long)
        per_case = nexts.groupBy(CASE, F.col("activity").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
        per_case = per_case.withColumn("steps", F.sum("n").over(Window.partitionBy(CASE)) - 1)
        # every case has exactly one event without a successor; it carries the case itself
        return per_case.select(
            "src", "dst",
            F.when(F.col("dst").isNull(), F.lit(1)).otherwise(0).alias("cases"),
            F.when(F.col("dst").isNull(), F.when(F.col("steps") == 0, F.lit(1.0)).otherwise(0.0))
            .otherwise(F.col("n") / F.col("steps")).alias("weight"))

    per_step = log.each(weights).groupBy("src", "dst").agg(
        F.sum("cases").alias("cases"), F.sum("weight").alias("weight"))
    known = reference.select("src", "dst").distinct().withColumn("known", F.lit(True))
    hits = F.when(F.col("dst").isNull() | F.col("known"), F.col("weight")).otherwise(0.0)
    return per_step.join(known, ["src", "dst"], "left").agg(
        F.coalesce(F.sum("cases"), F.lit(0)).alias("n_cases"),
        F.coalesce(F.sum(hits) / F.sum("cases"), F.lit(1.0)).alias("fitness"))


# --- everything at once ---------------------------------------------------------------------------------------------

# kinds of rows in :func:`log_facts`
TOTAL, BAD_CASE, ACTIVITY, STEP, TIMED = "total", "bad_case", "activity", "step", "timed"


class CaseMeasures:
    """What a pack of detectors wants to know of each case beside the order of its events, for :func:`log_facts`.

    ``columns`` are the event columns it reads. ``of_event`` and ``of_case`` give arrays of records (see :func:`record`) of an event and of a
    case; the latter from the aggregates in ``flags``, which are named and run over all events of the case.
    """

    columns: list[str] = []
    flags: dict[str, Column] = {}

    def of_event(self) -> list[Column]:
        return []

    def of_case(self) -> list[Column]:
        return []


def record(kind: str, src: Column, dst: Column | None = None, us: Column | None = None, at_us: Column | None = None) -> Column:
    """One measurement: those of the same kind, ``src`` and ``dst`` are counted, ``us`` is summed, the largest ``at_us`` is kept."""
    return F.struct(F.lit(kind).alias("kind"), src.alias("src"), (F.lit("") if dst is None else dst).alias("dst"),
                    (F.lit(0) if us is None else us).cast("long").alias("us"),
                    (F.lit(None) if at_us is None else at_us).cast("long").alias("at_us"))


def _facts_per_case(events: DataFrame, is_long: bool, more: CaseMeasures) -> DataFrame:
    columns = dict.fromkeys([CASE, "activity", "ts", "ingest_seq", *more.columns])
    narrow = events.select(*columns)
    nexts = with_next(narrow, CASE, TIME_ORDER, {"then": "activity"}, is_long)
    nexts = with_next(nexts, CASE, RECORDED_ORDER, {"recorded_then": "activity", "recorded_ts": "ts"}, is_long)
    gap = F.unix_micros("recorded_ts") - F.unix_micros("ts")
    of_case = None
    if more.flags and not is_long:
        # the last recorded event has seen the whole case
        so_far = Window.partitionBy(CASE).orderBy(*RECORDED_ORDER).rowsBetween(Window.unboundedPreceding, 0)
        nexts = nexts.withColumns({name: flag.over(so_far) for name, flag in more.flags.items()})
        of_case = F.when(F.col("recorded_then").isNull(), F.array(*more.of_case()))

    own = F.col("activity")
    records = F.array(
        record(ACTIVITY, own),
        record(STEP, own, F.col("then")),
        record(TIMED, own, F.col("recorded_then"), gap),
        # exactly one event of a case has no successor; it also stands for the case
        F.when(F.col("then").isNull(), record(TOTAL, F.lit(""))), *more.of_event())
    if of_case is not None:
        records = F.when(of_case.isNull(), records).otherwise(F.concat(records, of_case))
    rows = nexts.select(CASE, F.inline(records)).where("dst is not null")
    if more.flags and is_long:
        # a long case is added up in pieces
        flags = events.groupBy(CASE).agg(*[flag.alias(name) for name, flag in more.flags.items()])
        rows = rows.unionByName(flags.select(CASE, F.inline(F.array(*more.of_case()))).where("dst is not null"))
    backwards = (F.col("kind") == TIMED) & (F.col("us") < 0)
    summed = rows.groupBy(CASE, "kind", "src", "dst").agg(
        F.count(F.lit(1)).alias("n"), *micros_summed("us"), F.max("at_us").alias("at_us"),
        F.count_if(backwards).alias("errors"))
    return summed.withColumn("case_errors", F.sum("errors").over(Window.partitionBy(CASE)))


def log_facts(log: EventLog, more: CaseMeasures | None = None) -> DataFrame:
    """All measurements the registers need, from one pass and one shuffle of the log by case.

    Columns ``kind, src, dst, n, n_cases, n_repeat, us`` (decimal), ``at_us``. Kinds: ``activity`` (events, cases, cases with repeats),
    ``step`` (time order, all cases), ``timed`` (recorded order, cases without errors, summed gap), ``bad_case``
    (``src`` is the case, ``n`` its errors), ``total`` (``n`` cases, ``n_cases`` cases with errors) and those of ``more``.
    """
    more = more or CaseMeasures()
    per_case = log.each(lambda events, is_long: _facts_per_case(events, is_long, more))
    zero = F.lit(0).cast("long")
    clean = F.col("case_errors") == 0

    def row(kind: Column, src: Column, dst: Column, n: Column, cases: Column, repeat: Column, s: Column, us: Column, at: Column) -> Column:
        return F.struct(kind.alias("kind"), src.alias("src"), dst.alias("dst"), n.alias("n"), cases.alias("n_cases"),
                        repeat.alias("n_repeat"), s.alias("_s"), us.alias("_us"), at.alias("at_us"))

    total = F.col("kind") == TOTAL
    own = F.when((F.col("kind") != TIMED) | clean, row(
        F.col("kind"), F.col("src"), F.col("dst"), F.col("n"),
        F.when(total, (~clean).cast("long")).otherwise(1), (F.col("n") > 1).cast("long"), F.col("_s"), F.col("_us"), F.col("at_us")))
    bad = F.when(total & ~clean, row(
        F.lit(BAD_CASE), F.col(CASE), F.lit(""), F.col("case_errors"), zero, zero, zero, zero, F.lit(None).cast("long")))
    rows = per_case.select(F.inline(F.array(own, bad))).where("kind is not null")
    return rows.groupBy("kind", "src", "dst").agg(
        F.sum("n").alias("n"), F.sum("n_cases").alias("n_cases"), F.sum("n_repeat").alias("n_repeat"),
        micros_of_sums().alias("us"), F.max("at_us").alias("at_us"))


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).drop("kind")


def durations(facts: DataFrame) -> DataFrame:
    """Timed steps of :func:`log_facts` with their mean: ``src, dst, n, total_us, mean_s``."""
    timed = of_kind(facts, TIMED).select("src", "dst", "n", F.col("us").alias("total_us"))
    return timed.withColumn("mean_s", mean_seconds(F.col("total_us"), F.col("n")))


def summary(facts: DataFrame) -> DataFrame:
    """Compact description of a log as ``section, key, value``."""
    total = of_kind(facts, TOTAL)
    activity = of_kind(facts, ACTIVITY)
    n_cases = total.select("n").scalar()

    def section(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), key.alias("key"), value.cast("double").alias("value"))

    slow = durations(facts).orderBy(F.desc("mean_s"), "src", "dst").limit(fixed.SUMMARY_SLOWEST)
    parts = [
        section(total, "n_cases", F.lit(""), F.col("n")),
        section(activity, "activity_frequency", F.col("src"), F.col("n")),
        section(activity, "activity_case_coverage", F.col("src"), F.round(F.col("n_cases") / n_cases, 3)),
        section(slow, "slow_transitions", F.concat("src", F.lit("->"), "dst"), F.round("mean_s", 1)),
        section(activity.where("n_repeat > 0"), "rework_cases_by_activity", F.col("src"), F.col("n_repeat")),
        section(total, "cases_with_recording_errors", F.lit(""), F.col("n_cases")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole

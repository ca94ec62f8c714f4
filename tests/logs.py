"""Event logs for the tests: small logs, each with one planted defect, and what they make together."""

from datetime import datetime, timedelta, timezone

from casetrail import schema
from casetrail.operators.mining import EventLog

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
HOUR, DAY = 3_600, 86_400
MONDAY = 1_650_240_000


def event_log(spark, events):
    """``events`` are (case, activity, seconds[, resource, system, fqn]) in recorded order."""
    rows = []
    for i, (case, activity, seconds, *rest) in enumerate(events):
        resource, system, fqn = [*rest, "", "", ""][:3]
        rows.append((i, case, activity, EPOCH + timedelta(seconds=seconds), resource, system, fqn))
    return EventLog(spark.createDataFrame(rows, schema.EVENT_LOG))


# two orderly parcels, one of them packed twice, and one whose shipping was written down with an earlier time
PARCELS = [("p1", "pick", 3), ("p1", "pack", 9), ("p1", "ship", 21),
           ("p2", "pick", 4), ("p2", "pack", 6), ("p2", "pack", 13), ("p2", "ship", 33),
           ("p3", "pick", 50), ("p3", "ship", 40), ("p3", "pack", 70)]


def walk(case, steps, start=MONDAY, **more):
    """One case: ``steps`` are (activity, hours after the step before); ``more`` gives who, system and fqn per activity."""
    events, at = [], start
    for activity, hours in steps:
        at += int(hours * HOUR)
        given = {**more.get("every", {}), **more.get(activity, {})}
        events.append((case, activity, at, given.get("who", "desk"), given.get("system", "claims"), given.get("fqn", f"claim.{case}")))
    return events


CLAIM = [("Open", 1), ("Assess", 2), ("Decide", 90), ("Notify", 2), ("Close", 3)]


def claims(note="desk"):
    """Insurance claims: decisions are slow; of 40 cases 9 skip them, 5 are assessed again, 3 are closed before they open."""
    events = []
    for n in range(40):
        steps = list(CLAIM)
        if n < 9:
            steps = [s for s in steps if s[0] != "Decide"]
        elif n < 14:
            steps.insert(2, ("Assess", 4))
        elif n < 17:
            steps[-1] = ("Close", -400)
        who = {"Notify": {"who": f"call {note}"}} if n == 20 else {}
        events += walk(f"claim {n}", steps, MONDAY + n * DAY, **who)
    return events


CLAIMS_KEY = [("bottleneck", "Assess->Decide"), ("control-gap", "Decide"), ("rework", "Assess"), ("recording-error", "log")]

FINANCE = {"system": "finance"}
JOB = [("Lead", 1), ("Quote", 5), ("QuoteApproved", 6), ("Scheduled", 3), ("Attended", 4), ("JobComplete", 2), ("Invoice", 7), ("Paid", 8)]


def jobs(name, count, steps=JOB, approver="manager", hours=None):
    """``count`` jobs that all go the same way, with a day between them."""
    events = []
    for n in range(count):
        case = f"{name}/{n}"
        timed = [(a, (hours or {}).get(a, h)) for a, h in steps]
        events += walk(case, timed, MONDAY + n * DAY, every={"who": "crew", "system": "fsm", "fqn": f"fsm.job.{case}"},
                       QuoteApproved={"who": approver}, Invoice={**FINANCE, "fqn": f"finance.invoice.{case}"},
                       Paid={**FINANCE, "fqn": f"finance.invoice.{case}"})
    return events


def but(*left_out):
    return [s for s in JOB if s[0] not in left_out]


def assets(name, count, days_ago):
    return [(f"{name}/{n}", "RoutineService", MONDAY + (60 - days_ago) * DAY, "crew", "compliance", f"asset.{name}.{n}") for n in range(count)]


# kind -> (its key, a log in which jobs of that kind stand among good ones)
DEFECTS = {
    "unbilled-completion": ("JobComplete", jobs("unbilled", 3, but("Invoice", "Paid"))),
    "rectification-stall": ("DefectRaised", jobs("stalled", 2, [*JOB, ("DefectRaised", 4)])
                            + jobs("mended", 2, [*JOB, ("DefectRaised", 4), ("RectifyQuote", 1), ("RectifyApproved", 1), ("RectifyComplete", 9)])),
    "compliance-overdue": ("RoutineService", assets("late", 2, 420) + assets("fresh", 5, 20)),
    "approval-gap": ("QuoteApproved", jobs("unapproved", 3, but("QuoteApproved"))),
    "rework-loop": ("Attended", jobs("again", 4, [*JOB[:5], ("Attended", 3), *JOB[5:]])),
    "dispatch-bottleneck": ("Scheduled->Attended", jobs("waiting", 4, hours={"Attended": 300})),
    "recording-error": ("log", jobs("backdated", 2, hours={"Invoice": -70})),
    "segregation-of-duties": ("Quote/QuoteApproved", jobs("alone", 3, approver="crew")),
    "cross-source-orphan": ("Invoice", jobs("undone", 3, but("JobComplete"))),
}
GOOD = jobs("good", 12)
FIELD_SERVICE_KEY = [(kind, key) for kind, (key, _) in DEFECTS.items()]
# something an answer key may hold that no detector looks for
HELD_OUT = ("duplicate-invoice", "Invoice/duplicate")


def field_service():
    """All planted defects in one log, among good jobs."""
    return GOOD + [e for _, events in DEFECTS.values() for e in events]

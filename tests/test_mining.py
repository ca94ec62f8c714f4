import random
import re
from collections import Counter, defaultdict
from datetime import date

import pytest

from casetrail.operators import mining as M
from casetrail.operators.mining import EventLog
from casetrail.plans import inputs
from casetrail.plans.queries import durations
from logs import PARCELS, event_log


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_parcels(spark):
    log = event_log(spark, PARCELS)
    dfg = {(r.src, r.dst): r.n for r in M.directly_follows(log).collect()}
    assert dfg == {("pick", "pack"): 3, ("pack", "ship"): 2, ("pack", "pack"): 1, ("ship", "pick"): 1}
    assert rows(M.rework(log)) == [("pack", 1)]
    assert rows(M.selfloops(log)) == [("pack", 1)]
    assert rows(M.recording_errors(log)) == [("p3", 1)]
    assert {r.activity: r.coverage for r in M.coverage(log).collect()} == {"pick": 1.0, "pack": 1.0, "ship": 1.0}
    assert rows(M.throughput(log)) == [("p1", 18_000_000), ("p2", 29_000_000), ("p3", 30_000_000)]
    assert rows(M.transition_durations(log), "src", "dst", "n", "mean_s") == [
        ("pack", "pack", 1, 7.0), ("pack", "ship", 2, 16.0), ("pick", "pack", 2, 4.0)]
    found = M.variants(log)
    spelled = defaultdict(list)
    for r in M.variant_steps(log, found).orderBy("variant", "position").collect():
        spelled[r.variant].append(r.activity)
    assert sorted(spelled.values()) == [["pick", "pack", "pack", "ship"], ["pick", "pack", "ship"], ["ship", "pick", "pack"]]
    assert sorted(r.n_cases for r in found.collect()) == [1, 1, 1]


def test_variants_are_named_alike_whatever_the_length(spark, request):
    events = [(f"c{n}", "xyz"[i % (2 + n % 2)], i) for n in range(6) for i in range(5 + n % 2)] + [
        (f"long{n}", "abcde"[i * i % 5], i) for n in range(2) for i in range(12_000)]
    log = event_log(spark, events)
    plain = rows(M.variants(log))
    assert sorted(r[1:3] for r in plain) == [(5, 3), (6, 3), (12_000, 2)]
    request.getfixturevalue("tiny_groups")
    again = event_log(spark, events)
    assert again.long_keys and rows(M.variants(again)) == plain


def test_equal_times_keep_the_recorded_order_and_are_no_error(spark):
    log = event_log(spark, [("A", "x", 5), ("A", "y", 5), ("A", "z", 5)])
    assert rows(M.directly_follows(log)) == [("x", "y", 1), ("y", "z", 1)]
    assert rows(M.recording_errors(log)) == []


def test_fitness(spark):
    log = event_log(spark, [("n", "load", 2), ("n", "drive", 7), ("n", "drop", 8), ("n", "drive", 9)])
    assert M.dfg_fitness(log, M.directly_follows(log)).first().fitness == 1.0
    other = event_log(spark, [("m", "load", 1), ("m", "drive", 2), ("m", "park", 3), ("m", "drive", 4), ("k", "load", 1)])
    assert M.dfg_fitness(other, M.directly_follows(log)).first().fitness == pytest.approx((1 / 3 + 1) / 2)
    empty = event_log(spark, [])
    assert M.dfg_fitness(empty, M.directly_follows(log)).first().fitness == 1.0


def random_events(seed=5, n=400):
    """One case holds a third of all events, times often repeat and sometimes go back."""
    rng = random.Random(seed)
    events = []
    for _ in range(n):
        case = "hot" if rng.random() < 0.34 else f"c{rng.randrange(40)}"
        events.append((case, rng.choice("abcd"), rng.randrange(60) if case == "hot" else rng.randrange(5)))
    return events


def by_hand(events):
    cases = defaultdict(list)
    for i, (case, activity, t) in enumerate(events):
        cases[case].append((t, i, activity))
    dfg, timed, errors, sequences = Counter(), defaultdict(list), Counter(), Counter()
    for case, recorded in cases.items():
        ordered = [a for _, _, a in sorted(recorded)]
        sequences[tuple(ordered)] += 1
        dfg.update(zip(ordered, ordered[1:]))
        gaps = [(x[2], y[2], y[0] - x[0]) for x, y in zip(recorded, recorded[1:])]
        wrong = sum(g < 0 for _, _, g in gaps)
        if wrong:
            errors[case] = wrong
        else:
            for a, b, g in gaps:
                timed[a, b].append(g)
    return cases, dfg, timed, errors, sequences


@pytest.mark.parametrize("piecewise", [False, True])
def test_against_brute_force(spark, request, piecewise):
    if piecewise:
        request.getfixturevalue("tiny_groups")
    events = random_events()
    cases, dfg, timed, errors, sequences = by_hand(events)
    log = event_log(spark, events)
    log.rows = log.rows.repartition(7)
    assert bool(log.long_keys) == piecewise
    assert {(r.src, r.dst): r.n for r in M.directly_follows(log).collect()} == dfg
    assert {r.case_id: r.n_errors for r in M.recording_errors(log).collect()} == errors
    assert {(r.src, r.dst): (r.n, r.total_us) for r in M.transition_durations(log).collect()} == {
        k: (len(g), sum(g) * 1_000_000) for k, g in timed.items()}
    known = [pair for pair in dfg if pair[0] < pair[1]]
    reference = spark.createDataFrame(known, "src string, dst string")
    shares = []
    for recorded in cases.values():
        ordered = [a for _, _, a in sorted(recorded)]
        pairs = list(zip(ordered, ordered[1:]))
        shares.append(sum(p in known for p in pairs) / len(pairs) if pairs else 1.0)
    assert M.dfg_fitness(log, reference).first().fitness == pytest.approx(sum(shares) / len(shares))

    found = M.variants(log)
    assert sorted(r.n_cases for r in found.collect()) == sorted(sequences.values())
    spelled = defaultdict(dict)
    for r in M.variant_steps(log, found).collect():
        spelled[r.variant][r.position] = r.activity
    counts = {r.variant: r.n_cases for r in found.collect()}
    assert {tuple(s[i] for i in sorted(s)): counts[v] for v, s in spelled.items()} == sequences

    facts = M.log_facts(log)
    step = {(r.src, r.dst): r.n for r in M.of_kind(facts, M.STEP).collect()}
    assert step == dfg
    assert {(r.src, r.dst): (r.n, r.total_us) for r in M.durations(facts).collect()} == {
        k: (len(g), sum(g) * 1_000_000) for k, g in timed.items()}
    total = M.of_kind(facts, M.TOTAL).first()
    assert (total.n, total.n_cases) == (len(cases), len(errors))
    assert {r.src: r.n for r in M.of_kind(facts, M.BAD_CASE).collect()} == errors
    activity = {r.src: (r.n, r.n_cases, r.n_repeat) for r in M.of_kind(facts, M.ACTIVITY).collect()}
    for a in "abcd":
        per_case = [sum(x == a for _, _, x in recorded) for recorded in cases.values()]
        assert activity[a] == (sum(per_case), sum(n > 0 for n in per_case), sum(n > 1 for n in per_case))


def test_sums_beyond_a_long(spark):
    """Forty steps of eight thousand years: about 10^19 microseconds. The long case has gaps that add up to as much, and goes back."""
    far = 250_000_000_000
    events = [e for n in range(40) for e in ((f"c{n}", "x", n), (f"c{n}", "y", far))]
    events += [("back", "xy"[i % 2], far * (i % 2)) for i in range(80)]
    log = event_log(spark, events)
    total = sum(far - n for n in range(40)) * 1_000_000
    assert total > 1 << 63
    wanted = [("x", "y", 40, total, pytest.approx(total / 40 / 1_000_000))]
    for found in (M.transition_durations(log), M.durations(M.log_facts(log))):
        assert [tuple(r) for r in found.select("src", "dst", "n", "total_us", "mean_s").collect()] == wanted
    assert [(r.n, r.total_us) for r in durations(log).collect()] == [(40, total)]
    assert dict(durations(event_log(spark, PARCELS)).dtypes)["total_us"] == "bigint"


def test_a_task_gets_a_bounded_number_of_events(spark):
    """Four hundred events for tasks of twenty: the cases are dealt to twenty tasks, whatever Spark would choose; the facts stay the same."""
    def facts():
        log = event_log(spark, random_events())
        found = M.log_facts(log)
        return found._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, found.collect()), key=str)

    usual, expected = facts()
    spark.conf.set("casetrail.taskRows", "20")
    try:
        plan, found = facts()
        assert log_partitions(plan) == 20 != log_partitions(usual)
        assert found == expected
        long = EventLog(event_log(spark, random_events()).events, ["hot"], 400)
        assert sorted(map(tuple, M.log_facts(long).collect()), key=str) == expected
    finally:
        spark.conf.unset("casetrail.taskRows")


def log_partitions(plan):
    """Tasks that the cases are dealt to."""
    return int(re.search(r"Exchange hashpartitioning\(case_id#\d+, (\d+)\)", plan)[1])


def test_the_bound_of_events_is_none_too_low(spark, tmp_path):
    orders = [(i, i % 7, "OFP"[i % 3], date(2024, 1, 1 + i % 28)) for i in range(40)]
    lines = [(i % 40, i % 9, i % 5, i // 40, "NAR"[i % 3], "OF"[i % 2], date(2024, 2, 1 + i % 28), float(i % 51), 1.0, 0.0, 0.0) for i in range(160)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string,
        l_shipdate date, l_quantity double, l_extendedprice double, l_discount double, l_tax double""").write.parquet(f"{tmp_path}/lineitem.parquet")
    log = inputs.job_log(spark, str(tmp_path))
    assert log.most_events == 400 >= log.events.count() > 200


def test_only_the_hot_case_is_cut(spark):
    spark.conf.set("casetrail.longGroupRows", "50")
    try:
        log = event_log(spark, random_events())
        assert log.long_keys == ["hot"]
        assert {(r.src, r.dst): r.n for r in M.directly_follows(log).collect()} == by_hand(random_events())[1]
    finally:
        spark.conf.unset("casetrail.longGroupRows")

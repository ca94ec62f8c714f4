import json

import pytest
from pyspark.sql import functions as F

from casetrail import schema
from casetrail.functions import text
from casetrail.functions.scrub import scrub_columns
from casetrail.operators import field_service as field_service_pack
from casetrail.operators import findings, grading, packs, register
from casetrail.operators.mining import EventLog, log_facts
from casetrail.session import stash
from casetrail.sources.store import Store
from logs import CLAIMS_KEY, DEFECTS, FIELD_SERVICE_KEY, GOOD, HELD_OUT, claims, event_log, field_service, jobs


def keys(df):
    return {(r.kind, r.key) for r in df.collect()}


def scores(spark, detected, log, key, naive):
    answers = spark.createDataFrame(key, "kind string, key string")
    events = register.event_fqns(log.events)
    ours = grading.grade(findings.findings(detected), answers, findings.metrics(detected), events)
    theirs = grading.grade(naive, answers, events)
    return ({r.population: r for r in ours.collect()}, {r.population: r for r in theirs.collect()},
            {r.population: r for r in grading.compare(ours, theirs).collect()})


def test_claims(spark):
    log = event_log(spark, claims())
    detected = stash(packs.run_pack("quote-to-cash", log))
    assert keys(detected) == set(CLAIMS_KEY)
    ours, naive, compared = scores(spark, detected, log, CLAIMS_KEY, grading.naive_baseline(log))
    assert ours["gated"].f1 == 1.0 and ours["gated"].hallucination_rate == 0.0
    assert naive["gated"].f1 < 0.5
    assert compared["gated"].rel_error_reduction == 1.0


def test_secret_does_not_survive_loading(spark):
    secret = "sk-ant-api03-" + "Qx7" * 12
    log = event_log(spark, claims(note=secret))
    clean = scrub_columns(log.events, ["resource"])
    leaks = {r.column_name: r.n_leaks for r in grading.leak_check(clean, [secret]).collect()}
    assert leaks == {c: 0 for c in ("case_id", "activity", "resource", "source_system", "entity_fqn")}
    assert {r.column_name: r.n_leaks for r in grading.leak_check(log.events, [secret]).collect()}["resource"] == 1


def test_field_service(spark):
    log = event_log(spark, field_service())
    detected = stash(packs.run_pack("field-service", log))
    assert keys(detected) == set(FIELD_SERVICE_KEY)
    ours, naive, _ = scores(spark, detected, log, [*FIELD_SERVICE_KEY, HELD_OUT], grading.naive_field_service_baseline(log))
    gated = ours["gated"]
    assert (gated.precision, gated.recall, gated.f1, gated.hallucination_rate) == (1.0, 0.9, 0.9474, 0.0)
    assert naive["gated"].f1 == 0.0
    best = findings.register(detected).first()
    assert best.score == detected.agg(F.max("score")).first()[0]


@pytest.mark.parametrize("kind", sorted(DEFECTS))
def test_each_defect_alone(spark, kind):
    key, events = DEFECTS[kind]
    assert keys(packs.run_pack("field-service", event_log(spark, GOOD + events))) == {(kind, key)}


def test_good_jobs_are_quiet(spark):
    assert packs.run_pack("field-service", event_log(spark, GOOD)).count() == 0


def unbilled_jobs():
    return jobs("paid", 9) + DEFECTS["unbilled-completion"][1]


@pytest.mark.parametrize("cite, severity", [("fsm.job.unbilled/0", 0.85), ("metric.unbilled-completion.JobComplete", 0.91)])
def test_candidates_must_cite_their_metric(spark, cite, severity):
    log = event_log(spark, unbilled_jobs())
    detected = stash(packs.run_pack("field-service", log))
    candidates = spark.createDataFrame(
        [("unbilled-completion", "a claim", "JobComplete", "0.91", "0.3", "0.2", cite)],
        "kind string, title string, key string, severity string, frequency string, fixability string, evidence_fqn string")
    merged = register.merge_candidates(candidates, detected, register.event_fqns(log.events))
    own = merged.where("kind = 'unbilled-completion'").collect()
    assert [r.severity for r in own] == [severity]
    assert own[0].evidence_fqn == "metric.unbilled-completion.JobComplete"
    assert keys(detected) <= keys(merged)


def finding(kind, key, fqn="e", score=0.1, order=1, severity=0.5, title="t"):
    return (order, kind, title, key, severity, 0.5, 0.5, score, fqn, 1.0)


def test_duplicates_count_once(spark):
    rows = spark.createDataFrame([finding("control-gap", "Weigh"), finding("Control-Gap ", " weigh"), finding("control-gap", "WEIGH")], schema.FINDINGS)
    answers = spark.createDataFrame([("rework", "Seal")], "kind string, key string")
    nothing = spark.createDataFrame([], "fqn string")
    graded = {r.population: r for r in grading.grade(rows, answers, nothing).collect()}
    assert (graded["ungated"].fp, graded["gated"].fp, graded["gated"].f1) == (1, 0, 0.0)
    assert graded["ungated"].hallucination_rate == 1.0 and graded["ungated"].n_findings == 3


@pytest.mark.parametrize("ours, base, expected", [(1.0, 0.4, 1.0), (0.7, 0.4, 0.5), (0.25, 0.0, 0.25), (0.9, 1.0, 0.0)])
def test_relative_error_reduction(spark, ours, base, expected):
    row = spark.range(1).select(grading.relative_error_reduction(F.lit(ours), F.lit(base)).alias("r")).first()
    assert row.r == expected


def test_citations(spark):
    rows = spark.createDataFrame([("dock.gate.7",), ("metric.wait",), ("metric.wai",), ("",), ("dock.gate.7",)], "evidence_fqn string")
    sources = [spark.createDataFrame([(n,), (n,)], "fqn string") for n in ("dock.gate.7", "metric.wait")]
    flagged = sorted((r.evidence_fqn, r.grounded) for r in register.with_grounding(rows, *sources).collect())
    assert flagged == [("", False), ("dock.gate.7", True), ("dock.gate.7", True), ("metric.wai", False), ("metric.wait", True)]


def test_report(spark):
    rows = spark.createDataFrame([
        finding("compliance-overdue", "RoutineService", "metric.a", 0.3, 3, 0.95, "7 lifts past their inspection"),
        finding("unknown", "x", "metric.b", 0.00005, 1, 0.45, "+sum|A1")], schema.FINDINGS)
    lines = [r.line for r in register.report_text(rows, "trades").collect()]
    assert lines[0] == "# Discovery pain register, trades"
    assert lines[2].startswith("2 findings, ordered by impact")
    assert "| 1 | Critical | 7 lifts past their inspection | 0.3 |" in lines
    assert "| 2 | Medium | '+sum\\|A1 | 0.00005 |" in lines
    assert "- Recommendation: Review with the operator and agree a remediation." in lines
    assert lines.index("### 1. 7 lifts past their inspection") < lines.index("### 2. '+sum\\|A1")
    empty = [r.line for r in register.report_text(rows.limit(0), "trades").collect()]
    assert empty == ["# Discovery pain register, trades", "", "No material findings on the data reviewed."]


def test_clamp_and_bands(spark):
    values = spark.createDataFrame([(v,) for v in ("NaN", "-Infinity", "17", "-0.3", "half", None, " .75 ", "1e-1", "0x1", "7f")],
                                   "v string")
    assert [r[0] for r in values.select(text.clamp01(F.col("v"))).collect()] == [
        0.5, 0.5, 1.0, 0.0, 0.5, 0.5, 0.75, 0.1, 0.5, 0.5]
    bands = spark.createDataFrame([(v,) for v in (0.8, 0.79, 0.6, 0.4, 0.39)], "v double")
    assert [r[0] for r in bands.select(text.severity_band(F.col("v"))).collect()] == [
        "Critical", "High", "High", "Medium", "Low"]


def test_embedded_json(spark):
    replies = ['x ```json\n{"a": {"b": 1}}\n``` y', 'so {"a": 1} end', "none", "} {"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [r[0] for r in df.select(text.embedded_json(F.col("r"))).collect()] == [
        '{"a": {"b": 1}}', '{"a": 1}', "none", "} {"]


def test_artifacts_and_proposals(spark):
    kinds = ["Script ", "poem", "skill", "lesson", "training"]
    raw = [[(k, f" t{i} ", "r", "b") for i, k in enumerate(kinds)]]
    df = spark.createDataFrame([(raw[0],)], "a array<struct<type:string,title:string,rationale:string,body:string>>")
    cleaned = df.select(F.inline(text.clean_artifacts(F.col("a"))))
    assert [(r.type, r.title) for r in cleaned.collect()] == [("script", "t0"), ("skill", "t2")]
    named = cleaned.select(text.proposal_id(F.lit("f1"), F.col("type"), F.col("title"), F.lit(None).cast("string")))
    import hashlib
    assert named.first()[0] == hashlib.sha256(b"f1|script|t0|None").hexdigest()[:12]
    routes = spark.createDataFrame([(k,) for k in ("script", "skill", "lesson", "x")], "k string")
    assert [r[0] for r in routes.select(text.proposal_route(F.col("k"))).collect()] == ["queue", "queue", "auto", "auto"]


def test_fact_pack(spark):
    stored = spark.createDataFrame([(f"metric.{i:03d}", "n", float(i), "{}") for i in range(250)], schema.METRICS)
    for size in (250, 40):
        pack = register.fact_pack(stored, size).first()
        listed = json.loads(pack.facts)
        assert pack.n_facts == len(listed) == size
        assert [f["evidence_fqn"] for f in listed] == [f"metric.{i:03d}" for i in range(size)]
    rows = register.fact_rows(stored).orderBy("rank").collect()
    assert [json.loads(r.fact)["evidence_fqn"] for r in rows] == [f"metric.{i:03d}" for i in range(250)]
    assert register.fact_rows(stored, 7).count() == 7 and rows[0].rank == 1


def test_store_keeps_the_last_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "engagement"))
    first = spark.createDataFrame([("e.1", "deal", "old", "crm", {"a": "1"}), ("e.2", "deal", "two", "crm", {})],
                                  schema.ENTITIES)
    store.upsert("entities", first)
    store.upsert("entities", first.where("fqn = 'e.1'").withColumn("name", F.lit("new")))
    assert {r.fqn: r.name for r in store.read("entities").collect()} == {"e.1": "new", "e.2": "two"}
    detected = stash(packs.run_pack("field-service", event_log(spark, unbilled_jobs())))
    store.keep(detected)
    store.keep(detected)
    n = detected.count()
    assert store.read("metrics").count() == n and store.read("findings").count() == 2 * n


def test_custom_pack(spark):
    packs.add_pack("mine", lambda log: log.events.select("case_id"))
    try:
        assert packs.run_pack("mine", EventLog(event_log(spark, unbilled_jobs()).events)).count() == len(unbilled_jobs())
    finally:
        del packs.PACKS["mine"]


def test_one_pass_gives_the_counts_of_the_separate_ones(spark, tiny_groups):
    log = event_log(spark, field_service())
    for cases in ([], [r[0] for r in log.events.select("case_id").distinct().limit(5).collect()]):
        own = EventLog(log.events, cases)
        facts = stash(log_facts(own, field_service_pack.JobMeasures()), ["kind"])
        counts = field_service_pack.counts_of(facts)
        assert counts.first().asDict() == field_service_pack.case_counts(own).first().asDict()
        review = counts.select("latest_us").scalar()
        one, other = (sorted(map(tuple, df.select("entity_fqn", "last_us", "overdue").collect())) for df in (
            field_service_pack.services_of(facts, review), field_service_pack.asset_services(own)))
        assert one == other and one


def test_the_register_scans_and_shuffles_the_log_once(spark):
    events = event_log(spark, field_service()).events
    log = EventLog(stash(events), [])
    plan = log_facts(log, field_service_pack.JobMeasures())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    # one exchange by case, one for the sums over all cases
    assert plan.count("Exchange hashpartitioning") == 2


def test_an_empty_log_has_no_findings(spark):
    log = EventLog(event_log(spark, GOOD).events.limit(0))
    assert packs.run_pack("field-service", log).count() == 0 and packs.run_pack("quote-to-cash", log).count() == 0


def test_many_citations_go_through_a_filter(spark):
    cited = spark.createDataFrame([(f"e.{i}",) for i in range(0, 4_000, 2)] + [("",), (None,), ("e.0",)], "fqn string")
    source = stash(spark.range(3_000).selectExpr("concat('e.', id % 1500) as fqn").unionByName(spark.sql("select cast(null as string) as fqn")))
    expected = {f"e.{i}" for i in range(0, 1_500, 2)}
    for few in (10_000, 0):
        found = register.resolved_citations(cited, source, few=few)
        assert sorted(r.fqn for r in found.collect()) == sorted(expected)
    words, size = register.name_filter(cited.where("fqn <> ''").distinct(), 2_000)
    bits = {r.word: r.bits for r in words.collect()}
    strangers = spark.range(20_000).selectExpr("concat('x.', id) as fqn").select(register._word(size).alias("w"), register._mask().alias("m"))
    assert sum(bits.get(r.w, 0) & r.m == r.m for r in strangers.collect()) < 600
    # the source meets the filter where it is read; only what passes is exchanged
    plan = register.resolved_citations(cited, source, few=0)._jdf.queryExecution().executedPlan().toString()
    below_the_filter = plan[plan.rindex("BroadcastHashJoin"):].split("BroadcastExchange")[0]
    assert "FileScan parquet" in below_the_filter and "Exchange hashpartitioning" not in below_the_filter


def test_no_citations_and_no_sources(spark):
    none = spark.createDataFrame([], "fqn string")
    some = spark.createDataFrame([("a",)], "fqn string")
    assert register.resolved_citations(none, some).count() == 0 and register.resolved_citations(some, none, few=0).count() == 0

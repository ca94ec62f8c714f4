"""The registered queries: name -> function of a session and a folder with the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.functions import parse, scrub, text
from casetrail.operators import audit, conversations, field_service, findings, generic, grading, mining, packs, register
from casetrail.operators import sessions as S
from casetrail.operators.mining import EventLog
from casetrail.operators.ordering import Grouped, numbered
from casetrail.operators.replies import read_replies
from casetrail.plans import derived, inputs
from casetrail.session import shared_folder, spread, stash
from casetrail.sources import exports, jsonl
from casetrail.sources.exports import normalise_events
from casetrail.sources.jsonl import last_entries
from casetrail.sources.store import Store
from casetrail.streaming import sweep

Query = Callable[[SparkSession, str], DataFrame]

# uniform data hardly has slow steps or repeats, so some queries use lower bounds than the defaults of 2 and 0.1
FACTOR = 1.05
REWORK = 0.05
HOLD_OUT = 0.05
ALLOWED_HOSTS = ["api.example.com"]
ANSWERS = [
    ("unbilled-completion", "JobComplete"), ("rectification-stall", "defectraised "),
    ("compliance-overdue", "RoutineService"), ("approval-gap", "QuoteApproved"), ("rework-loop", "Attended"),
    ("dispatch-bottleneck", "Scheduled->Attended"), ("recording-error", "LOG"),
    ("segregation-of-duties", "Quote/QuoteApproved"), ("cross-source-orphan", "Invoice"),
    ("duplicate-invoice", "Invoice/duplicate"),
]


def job_log(spark: SparkSession, sf_dir: str) -> EventLog:
    return inputs.job_log(spark, sf_dir)


def landed_job_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """The job log stored once, for queries that go over it several times."""
    log = inputs.job_log(spark, sf_dir)
    return EventLog(stash(log.events), log.long_keys, log.most_events)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stash(mining.log_facts(job_log(spark, sf_dir)), ["kind"])


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "kind string, key string")


# --- mining ---------------------------------------------------------------------------------------------------------


def variants(log: EventLog) -> DataFrame:
    return mining.variants(log).select("variant", "length", "n_cases", "example_case")


def durations(log: EventLog) -> DataFrame:
    """The total is a long, as in the SQL twin, unless one of them needs more room: then all are decimals."""
    timed = stash(mining.transition_durations(log).withColumn("mean_s", F.round("mean_s", 3)))
    fits = timed.where("abs(total_us) > 9223372036854775807").isEmpty()
    return timed.withColumn("total_us", F.col("total_us").cast("long")) if fits else timed


def coverage(log: EventLog) -> DataFrame:
    return mining.coverage(log).withColumn("coverage", F.round("coverage", 6))


def variant_steps(log: EventLog) -> DataFrame:
    """The sequences of all variants, one row per step."""
    return mining.variant_steps(log, stash(mining.variants(log)))


def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the steps of a case that take less than twenty days on average in jobs recorded without an error."""
    log = landed_job_log(spark, sf_dir)
    known = mining.transition_durations(log).where("total_us < cast(n as decimal(20,0)) * 1728000000000")
    return mining.dfg_fitness(log, known).withColumn("fitness", F.round("fitness", 6))


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.summary(facts(spark, sf_dir))


def on_jobs(measure: Callable[[EventLog], DataFrame]) -> Query:
    return lambda spark, sf_dir: measure(job_log(spark, sf_dir))


def on_landed_jobs(measure: Callable[[EventLog], DataFrame]) -> Query:
    return lambda spark, sf_dir: measure(landed_job_log(spark, sf_dir))


def on_web(measure: Callable[[EventLog], DataFrame]) -> Query:
    return lambda spark, sf_dir: measure(inputs.activity_log(spark, sf_dir))


MINING: dict[str, Query] = {
    "activity_frequency": on_jobs(mining.activity_frequency),
    "dfg": on_jobs(mining.directly_follows),
    "selfloops": on_jobs(mining.selfloops),
    "rework": on_jobs(mining.rework),
    "throughput": on_jobs(mining.throughput),
    "transition_durations": on_jobs(durations),
    "coverage": on_jobs(coverage),
    "recording_errors": on_jobs(mining.recording_errors),
    "variants": on_jobs(variants),
    "variant_steps": on_landed_jobs(variant_steps),
    "dfg_fitness": fitness,
    "log_summary": log_summary,
    "web_activity_frequency": on_web(mining.activity_frequency),
    "web_dfg": on_web(mining.directly_follows),
    "web_throughput": on_web(mining.throughput),
    "web_transition_durations": on_web(durations),
    "web_coverage": on_web(coverage),
}

# --- findings -------------------------------------------------------------------------------------------------------


def full(detected: DataFrame) -> DataFrame:
    return detected.select(*findings.FINDING_COLUMNS, "metric_name", F.round("metric_value", 3).alias("metric_value"))


def from_facts(detect: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: full(detect(facts(spark, sf_dir)))


def from_counts(detect: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: full(detect(field_service.case_counts(job_log(spark, sf_dir))))


def overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(field_service.compliance_overdue(field_service.asset_counts(
        field_service.asset_services(landed_job_log(spark, sf_dir)))))


def asset_services(log: EventLog) -> DataFrame:
    return field_service.asset_services(log)


def field_service_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.run_field_service(job_log(spark, sf_dir), FACTOR)


def generic_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.register(packs.run_generic(job_log(spark, sf_dir), FACTOR))


FINDINGS: dict[str, Query] = {
    "bottlenecks": from_facts(lambda f: generic.bottlenecks(f, FACTOR)),
    "slowest_ten": from_facts(lambda f: generic.bottlenecks(f, FACTOR, keep=generic.fixed.BOTTLENECK_KEEP)),
    "rework_findings": from_facts(lambda f: generic.rework_findings(f, REWORK)),
    "control_gaps": from_facts(generic.control_gaps),
    "recording_error_finding": from_facts(generic.recording_error_finding),
    "generic_register": generic_register,
    "case_counts": on_jobs(lambda log: field_service.case_counts(log).drop("self_approved", "latest_us")),
    "unbilled_completion": from_counts(field_service.unbilled_completion),
    "rectification_stall": from_counts(field_service.rectification_stall),
    "compliance_overdue": overdue,
    "asset_services": on_landed_jobs(asset_services),
    "approval_gap": from_counts(field_service.approval_gap),
    "rework_loop": from_counts(field_service.rework_loop),
    "dispatch_bottleneck": from_facts(lambda f: field_service.dispatch_bottleneck(f, FACTOR)),
    "segregation_of_duties": from_counts(field_service.segregation_of_duties),
    "cross_source_orphan": from_counts(field_service.cross_source_orphan),
    "cross_source_orphan_cases": on_landed_jobs(field_service.cross_source_orphans),
    "field_service_register": lambda spark, sf_dir: findings.register(field_service_detections(spark, sf_dir)),
    "field_service_metrics": lambda spark, sf_dir: findings.metrics(
        field_service_detections(spark, sf_dir)).withColumn("value", F.round("value", 3)),
}

# --- registers and grading ------------------------------------------------------------------------------------------


def cited_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about customers, jobs and parts, about half of which exist as such."""

    def claims(name: str, key: str, prefix: str, factor: int) -> DataFrame:
        cite = F.concat(F.lit(prefix), (F.col(key) * factor).cast("string"))
        return inputs.table(spark, sf_dir, name).select(F.lit(name).alias("kind"), cite.alias("evidence_fqn"))

    empty = inputs.table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.lit("").alias("evidence_fqn"))
    return (claims("customer", "c_custkey", "crm.customer.", 2).unionByName(claims("orders", "o_orderkey", "fsm.job.", 2))
            .unionByName(claims("part", "p_partkey", "asset.", 1)).unionByName(empty))


def citation_gate(spark: SparkSession, sf_dir: str, few: int = register.FEW_NAMES) -> DataFrame:
    log = job_log(spark, sf_dir)
    flagged = register.with_grounding(cited_candidates(spark, sf_dir), inputs.entities(spark, sf_dir),
                                      register.event_fqns(log.events), few=few)
    return flagged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("grounded").alias("n_grounded"))


def citation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a Bloom filter, as for very many names."""
    return citation_gate(spark, sf_dir, few=0)


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made of the detections: odd detectors cite a job, scores are out of range or not numbers."""
    log = job_log(spark, sf_dir)
    detected = stash(packs.run_field_service(log, FACTOR))
    candidates = detected.select(
        "kind", F.concat(F.lit("Checked: "), "title").alias("title"), "key",
        (F.col("severity") + 0.5).cast("string").alias("severity"),
        F.when(F.col("key") == "Invoice", "nan").otherwise(F.col("frequency").cast("string")).alias("frequency"),
        F.lit("-1").alias("fixability"),
        F.when(F.col("detector_order") % 2 == 1, "fsm.job.0").otherwise(F.col("evidence_fqn")).alias("evidence_fqn"))
    return register.merge_candidates(candidates, detected, register.event_fqns(log.events))


def graded(spark: SparkSession, rows: DataFrame, log: EventLog, sf_dir: str, *more: DataFrame) -> DataFrame:
    return grading.grade(rows, answers(spark), inputs.entities(spark, sf_dir), register.event_fqns(log.events), *more)


def grade_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register, a copy of every finding in other letters and a claim nothing supports, graded together."""
    log = job_log(spark, sf_dir)
    detected = stash(packs.run_field_service(log, FACTOR))
    own = findings.findings(detected)
    copies = own.withColumns({"key": F.upper("key"), "detector_order": F.col("detector_order") + 100})
    loose = own.where("kind = 'rework-loop'").withColumns({
        "kind": F.lit("approval-gap"), "key": F.lit("Nowhere"), "evidence_fqn": F.lit("metric.none")})
    rows = own.unionByName(copies).unionByName(loose)
    return graded(spark, rows, log, sf_dir, findings.metrics(detected))


def rel_error_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = job_log(spark, sf_dir)
    detected = stash(packs.run_field_service(log, FACTOR))
    systems = {"ours": findings.findings(detected), "naive": grading.naive_field_service_baseline(log)}
    both = grading.grade_systems(systems, answers(spark), inputs.entities(spark, sf_dir), register.event_fqns(log.events),
                                 findings.metrics(detected))
    return grading.compare(both["ours"], both["naive"])


def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after two arrivals: overdrawn customers renamed (the later name wins), nations added."""
    stored = inputs.entities(spark, sf_dir).drop("attrs")
    customers = inputs.table(spark, sf_dir, "customer").where("c_acctbal < 0")
    fqn = F.concat(F.lit("crm.customer."), F.col("c_custkey").cast("string"))

    def renamed(title: str, seq: int) -> DataFrame:
        return customers.select(fqn.alias("fqn"), F.lit("customer").alias("kind"),
                                F.concat("c_name", F.lit(title)).alias("name"), F.lit("crm").alias("source_system"),
                                F.lit(seq).cast("long").alias("load_seq"))

    nations = inputs.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("erp.nation."), F.col("n_nationkey").cast("string")).alias("fqn"), F.lit("nation").alias("kind"),
        F.col("n_name").alias("name"), F.lit("erp").alias("source_system"), F.lit(1).cast("long").alias("load_seq"))
    arriving = renamed(" (second)", 2).unionByName(renamed(" (first)", 1)).unionByName(nations)
    return register.upsert(stored, arriving)


def metric_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals per customer as metrics, replaced where a customer has open orders."""
    orders = inputs.table(spark, sf_dir, "orders")

    def metric(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first"))
        return per.select(
            F.concat(F.lit("metric.orders."), F.col("o_custkey").cast("string")).alias("fqn"), F.lit(name).alias("name"),
            F.col("orders").cast("double").alias("value"), F.to_json(F.struct("orders", "first")).alias("evidence_json"))

    return register.upsert(metric(orders, "all_orders"), metric(orders.where("o_orderstatus = 'O'"), "open_orders"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.report_lines(stash(findings.findings(field_service_detections(spark, sf_dir))), "field service")


def report_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.ranked(stash(findings.findings(field_service_detections(spark, sf_dir)))).select(
        "rank", "priority", "kind", text.report_cell(F.col("title")).alias("title"), "score", "recommendation")


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that a store holds, as facts in order; their values come from orders per customer."""
    facts = register.fact_rows(metric_upsert(spark, sf_dir).drop("load_seq"))
    return facts.select("rank", *[F.get_json_object("fact", f"$.{name}").alias(name) for name in ("evidence_fqn", "name", "detail")],
                        F.get_json_object("fact", "$.value").cast("double").alias("value"))


def fact_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.fact_pack(findings.metrics(field_service_detections(spark, sf_dir)))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drafted artifacts: tidied, routed and named by content."""
    parts = inputs.table(spark, sf_dir, "part")
    kind = derived.choice(F.col("p_type"), {"ECONOMY": " Script", "STANDARD": "lesson", "PROMO": "skill"}).otherwise("memo")
    artifact = F.struct(kind.alias("type"), F.concat(F.lit(" "), "p_name").alias("title"),
                        F.col("p_brand").alias("rationale"), F.col("p_type").alias("body"))
    drafts = parts.select(F.col("p_partkey").cast("string").alias("finding"),
                          F.inline(text.clean_artifacts(F.array(artifact))))
    return drafts.select(
        text.proposal_id(F.col("finding"), F.col("type"), F.col("title"), F.col("body")).alias("id"), "type", "title",
        text.proposal_route(F.col("type")).alias("route"))


def drafts_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = proposals(spark, sf_dir).withColumn("status", F.when(F.col("route") == "queue", "pending").otherwise("written"))
    return drafts.unionByName(drafts)


def proposal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals per status; a draft that comes twice counts once."""
    return register.proposal_index(drafts_twice(spark, sf_dir))


def pending_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.pending_proposals(drafts_twice(spark, sf_dir))


def detect_and_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the field-service register as a store has them after two runs, the second one on scaled values."""
    store = Store(spark, f"{shared_folder(spark)}/casetrail/{uuid.uuid4().hex}")
    detected = stash(field_service_detections(spark, sf_dir))
    store.keep(detected.withColumn("metric_value", F.lit(-1.0)))
    store.keep(detected)
    seen = store.read("findings").groupBy(F.col("evidence_fqn").alias("fqn")).agg(F.count(F.lit(1)).alias("n_findings"))
    return store.read("metrics").join(seen, "fqn").select("fqn", "name", F.round("value", 3).alias("value"), "n_findings")


REGISTER: dict[str, Query] = {
    "naive_baseline": on_landed_jobs(grading.naive_baseline),
    "naive_field_service_baseline": on_landed_jobs(grading.naive_field_service_baseline),
    "citation_gate": citation_gate,
    "citation_filter": citation_filter,
    "first_entities": on_jobs(lambda log: register.first_entities(log.events)),
    "safety_net": merged_candidates,
    "grade_register": grade_register,
    "rel_error_reduction": rel_error_reduction,
    "entity_upsert": entity_upsert,
    "metric_upsert": metric_upsert,
    "report_ranked": report_ranked,
    "report_lines": report,
    "fact_pack": fact_pack,
    "fact_rows": fact_rows,
    "proposal_ids": proposals,
    "proposal_index": proposal_index,
    "pending_proposals": pending_proposals,
    "detect_and_store": detect_and_store,
}

# --- loading and scrubbing ------------------------------------------------------------------------------------------


def canonical_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.raw_statuses(spark, sf_dir).groupBy(
        parse.canonical_activity(F.col("status")).alias("activity")).agg(F.count(F.lit(1)).alias("n"))


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = derived.raw_times(spark, sf_dir).withColumn("us", F.unix_micros(parse.parse_timestamp(F.col("raw"))))
    return parsed.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("us").alias("n_parsed"),
        F.coalesce(F.sum(F.floor(F.col("us") / 1000)), F.lit(0)).alias("sum_ms"))


def event_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalise_events(derived.raw_cells(spark, sf_dir), "fsm", case_key="hash", salt="pepper")
    return events.select("ingest_seq", "case_id", "activity", F.unix_micros("ts").alias("us"), "resource",
                         "source_system", "entity_fqn")


def scrub_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of thing to scrub, planted in texts of which it is known what should be left."""
    scrubbed = derived.planted(spark, sf_dir).withColumn("s", scrub.scrub_counted(F.col("text")))
    return scrubbed.select("doc_id", "kind", F.col("s.text").alias("text"), F.to_json("s.counts").alias("counts"))


def one_rule(kind: str, texts: Query = derived.documents) -> Query:
    """Documents a single credential rule changes."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = next(r for r in scrub._credential_rules() if r.kind == kind)
        counted = texts(spark, sf_dir).select(
            "doc_id", rule.count(F.col("text")).cast("long").alias("n_hits"), F.sha2(rule.apply(F.col("text")), 256).alias("digest"))
        return counted.where("n_hits > 0")
    return query


def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = derived.documents(spark, sf_dir).withColumn("s", scrub.scrub_counted(F.col("text")))
    return cleaned.select("doc_id", F.col("s.text").alias("text"), F.to_json("s.counts").alias("counts"))


def scrub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.redaction_counts(derived.documents(spark, sf_dir), "text")


def redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.redaction_audit(derived.documents(spark, sf_dir), "text")


def tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns that would be blocked unredacted, and redacted."""
    turns = inputs.table(spark, sf_dir, "conversations")
    raw, cleaned = F.col("text"), scrub.redact(F.col("text"))
    return turns.select(scrub.hits(scrub.redact_counted(raw).counts).alias("before"),
                        scrub.hits(scrub.redact_counted(cleaned).counts).alias("after")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("before") > 0).alias("blocked_raw"),
        F.count_if(F.col("after") > 0).alias("blocked_redacted"))


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail hosts that occur in the documents, before and after redaction."""
    documents = derived.documents(spark, sf_dir).select("text", "lang", "source")
    cleaned = documents.withColumn("clean_text", scrub.redact(F.col("text")))
    return grading.leak_check(cleaned, ["@example.com", "@example.org", "password=", "@"])


def planted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per kind over texts in which one thing each is planted."""
    return S.redaction_counts(derived.planted(spark, sf_dir), "text")


def planted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that held a credential, and those that still do after one redaction."""
    return S.redaction_audit(derived.planted(spark, sf_dir), "text")


def planted_tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind, how many texts are blocked as they are, and once redacted."""
    texts = derived.planted(spark, sf_dir)
    blocked = S.tripwire(texts, "text")[1].select("kind", F.lit(1).alias("raw"), F.lit(0).alias("redacted"))
    again = S.tripwire(texts.withColumn("text", scrub.redact(F.col("text"))), "text")[1].select(
        "kind", F.lit(0).alias("raw"), F.lit(1).alias("redacted"))
    every = texts.select("kind", F.lit(0).alias("raw"), F.lit(0).alias("redacted"))
    return every.unionByName(blocked).unionByName(again).groupBy("kind").agg(
        F.sum("raw").alias("blocked_raw"), F.sum("redacted").alias("blocked_redacted"))


def planted_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted strings left in the texts and in the scrubbed texts."""
    texts = derived.planted(spark, sf_dir).select("text", scrub.scrub(F.col("text")).alias("clean_text"))
    return grading.leak_check(texts, derived.LEAKS)


LOADING: dict[str, Query] = {
    "planted_counts": planted_counts,
    "planted_audit": planted_audit,
    "planted_tripwire": planted_tripwire,
    "planted_leaks": planted_leaks,
    "canonical_status": canonical_status,
    "parse_timestamps": parse_timestamps,
    "event_normalise": event_normalise,
    "scrub_email": one_rule("email"),
    "scrub_assignment": one_rule("secret-assignment"),
    "scrub_private_ip": one_rule("private-ip", derived.with_addresses),
    "scrub_rules": scrub_rules,
    "scrub_documents": scrub_documents,
    "scrub_counts": scrub_counts,
    "redaction_audit": redaction_audit,
    "tripwire": tripwire,
    "leak_check": leak_check,
}

# --- readers: the given tables written out as text, and read back ---------------------------------------------------


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/casetrail/{uuid.uuid4().hex}"


def exported(spark: SparkSession, sf_dir: str, spanning: bool) -> DataFrame:
    """Orders as rows of an export: ``job, status, when, note``. With ``spanning`` some notes have two lines."""
    cells = derived.raw_cells(spark, sf_dir)
    note = F.col("resource")
    if spanning:
        note = F.when(F.col("activity") == "Settled", F.regexp_replace("resource", "^desk ", "desk\n")).otherwise(note)
    return cells.select(F.col("case_id").alias("job"), F.col("activity").alias("status"), F.col("ts").alias("when"),
                        note.alias("note"), (F.col("ingest_seq") / 4_000).cast("long").alias("part"))


def loaded(spark: SparkSession, path: str) -> DataFrame:
    raw = exports.read_export(spark, path, exports.ColumnMap("job", "status", "when", resource="note"))
    events = normalise_events(raw, "fsm", case_key="hash", salt="pepper")
    return events.select("case_id", "activity", F.unix_micros("ts").alias("us"), "resource", "entity_fqn")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several CSV files; in some of them cells span lines."""
    root = scratch(spark)
    rows = exported(spark, sf_dir, spanning=True).drop("part")
    rows.repartitionByRange(4, "status").write.option("header", True).option("escape", '"').csv(f"{root}/export")
    return loaded(spark, f"{root}/export")


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for every four thousand order numbers, in the two shapes in turn."""
    root = scratch(spark)
    listed = exported(spark, sf_dir, spanning=False).groupBy("part").agg(
        F.collect_list(F.struct("job", "status", "when", "note")).alias("rows"))
    whole = F.when(F.col("part") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct("rows")))
    listed.repartition("part").select("part", whole.alias("value")).write.partitionBy("part").text(f"{root}/export.json")
    return loaded(spark, f"{root}/export.json")


def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text")).write.json(root)
    rows = jsonl.strict_rows(jsonl.read_lines(spark, root))
    return rows.select(F.variant_get("row", "$.doc_id", "long").alias("doc_id"),
                       F.sha2(F.variant_get("row", "$.text", "string"), 256).alias("digest"))


def xes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directly-follows graph of the events, read from CSV files with the usual names of event logs."""
    root = scratch(spark)
    events = inputs.table(spark, sf_dir, "events")
    named = events.select(
        F.col("user_id").alias("case:concept:name"), F.col("event_type").alias("concept:name"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time:timestamp"),
        F.col("props").alias("org:resource"), "event_id")
    (named.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id")
     .write.option("header", True).option("escape", '"').csv(f"{root}/xes"))
    raw = exports.read_csv(spark, f"{root}/xes", exports.XES)
    return mining.directly_follows(EventLog(normalise_events(raw, "real", text.strip, case_key="hash", salt="x")))


def scrubbed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalise_events(derived.raw_cells(spark, sf_dir), "fsm")
    return events.select("ingest_seq", "case_id", "activity")


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of every user in index files that follow each other by name."""
    root = scratch(spark)
    events = inputs.table(spark, sf_dir, "events")
    lines = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.col("props").alias("cwd"),
                               F.col("event_type").alias("reason")))
    (events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select(lines.alias("value"))
     .write.text(f"{root}/index"))
    return jsonl.read_index(spark, f"{root}/index").select("session_id", "cwd", "reason")


def dataset_sources(spark: SparkSession, sf_dir: str, root: str, limits: dict[str, int]) -> list[dict]:
    """Two sources of several files with rows of four shapes, in the order of their documents."""
    documents = inputs.table(spark, sf_dir, "documents")
    body, reply = F.col("text"), F.col("lang")

    def turn(who: str, said: Column, role: str = "role", content: str = "content") -> Column:
        return F.struct(F.lit(who).alias(role), said.alias(content))

    shapes = [
        F.to_json(F.struct(F.array(turn("user", body), turn("assistant", reply)).alias("messages"))),
        F.to_json(F.struct(F.array(turn("human", body, "from", "value"), turn("gpt", reply, "from", "value")).alias("conversations"))),
        F.to_json(F.struct(body.alias("instruction"), reply.alias("output"))),
        F.to_json(F.struct(body.alias("prompt"), reply.alias("response")))]
    line = F.get(F.array(*shapes), (F.col("doc_id") % 8 / 2).cast("int"))
    sources = []
    for side, name in enumerate(("even", "odd")):
        path = f"{root}/{name}"
        own = documents.where(F.col("doc_id") % 2 == side).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        own.select(line.alias("value")).write.text(path)
        sources.append({"name": name, "path": path, "license": "internal", "limit": limits.get(name)})
    return sources


def dataset_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, checked and de-duplicated across both."""
    sources = dataset_sources(spark, sf_dir, scratch(spark), {})
    return conversations.source_stats(conversations.collect_records(conversations.read_sources(spark, sources)))


DATASET_LIMITS = {"even": 60, "odd": 90}
DATASET_TOTAL = 120


def dataset_limits(spark: SparkSession, sf_dir: str, limits: dict[str, int] = DATASET_LIMITS, total: int = DATASET_TOTAL) -> DataFrame:
    """Two sources of which only the first ``limits`` rows are taken, until ``total`` are written."""
    sources = dataset_sources(spark, sf_dir, scratch(spark), limits)
    rows = conversations.read_sources(spark, sources)
    return conversations.source_stats(conversations.collect_records(rows, max_total=total))


def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written records as JSON lines, one folder per split, and read back."""
    root = scratch(spark)
    records = conversations.collect_records(conversations.read_sources(spark, dataset_sources(spark, sf_dir, f"{root}/in", {})))
    jsonl.write_dataset(conversations.record_lines(records), f"{root}/out")
    rows = jsonl.strict_rows(jsonl.read_lines(spark, f"{root}/out", recursive=True))
    said = F.variant_get("row", "$.messages[0].content", "string")
    return rows.groupBy(F.variant_get("row", "$.source", "string").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(said)).alias("n_chars"),
        F.count_if(F.col("_file").contains("/split=")).alias("n_in_splits"))


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export loaded into a stored log: events in the order of the files."""
    root = scratch(spark)
    rows = exported(spark, sf_dir, spanning=False).drop("part").withColumn("key", F.substring("job", 3, 99).cast("long"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key").drop("key")
    rows.write.option("header", True).csv(f"{root}/export")
    columns = exports.ColumnMap("job", "status", "when", resource="note")
    log = exports.load_export(spark, f"{root}/export", columns, f"{root}/log", case_key="hash", salt="pepper")
    return numbered(log.events, ["ingest_seq"], "rank").select("rank", "case_id", "activity", F.unix_micros("ts").alias("us"))


def audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged statements appended to the audit table in two goes, and read back."""
    store = Store(spark, scratch(spark))
    judged = audit.sql_audit(derived.statements(spark, sf_dir))
    for odd in (0, 1):
        part = judged.where(F.col("o_orderkey") % 2 == odd)
        store.append("audit", audit.audit_rows(part, F.lit(0).cast("timestamp"), F.lit("agent"), F.lit("sql"),
                                               F.col("o_orderkey").cast("string"), F.lit("run")))
    return per_verdict(store.read("audit"))


def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from replies that hold JSON in a fenced block, or none."""
    return read_replies(derived.replies(spark, sf_dir)).select(
        "id", "status", "reason", "root_cause", F.round("confidence", 2).alias("confidence"), F.size("artifacts").cast("long").alias("n_artifacts"))


READERS: dict[str, Query] = {
    "csv_export": csv_export,
    "json_export": json_export,
    "jsonl_rows": jsonl_rows,
    "xes_log": xes_log,
    "event_normalise_scrubbed": scrubbed_cases,
    "session_index_files": index_files,
    "dataset_collect": dataset_collect,
    "dataset_limits": dataset_limits,
    "dataset_files": dataset_files,
    "stored_log": stored_log,
    "audit_sink": audit_sink,
    "reply_parsing": reply_parsing,
}

# --- sessions -------------------------------------------------------------------------------------------------------


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_stats(derived.transcripts(spark, sf_dir))


def tool_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_tools(S.tool_counts(derived.transcripts(spark, sf_dir)))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = S.user_messages(derived.transcripts(spark, sf_dir)).where("is_correction")
    return said.select("session_id", "place", "correction")


def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = S.user_messages(derived.transcripts(spark, sf_dir))
    return S.first_rows(said, "session_id", ["place"], S.fixed.SAMPLE_MESSAGES).select("session_id", "rank", "message")


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcript = derived.transcripts(spark, sf_dir)
    return S.excerpts(transcript, S.session_stats(transcript))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session index from the events: every event ends the session of its user once more."""
    events = inputs.table(spark, sf_dir, "events")
    return last_entries(events.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("place"),
        F.col("value").cast("string").alias("ts"), F.col("props").alias("cwd"), F.col("event_type").alias("reason")), ["place"])


def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.with_index(session_stats(spark, sf_dir), index_entries(spark, sf_dir))
    return stats.select("session_id", "n_events", "cwd", "end_reason")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for sessions with a system turn."""
    return inputs.table(spark, sf_dir, "conversations").where("role = 'system'").groupBy(
        F.col("conv_id").cast("string").alias("session_id")).agg(
        F.lit(" Build").alias("session_class"), F.lit(True).alias("rule_drift"),
        F.lit("  a   note ").alias("notes"))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage records; sessions with a system turn have a verdict."""
    return S.triage_records(session_stats(spark, sf_dir), verdicts(spark, sf_dir))


def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = triage(spark, sf_dir)
    return records.select("id", "salience", "session_class", "status", F.col("signals.errors").alias("errors"),
                          F.col("signals.notes").alias("notes"), F.col("facts.mutations").alias("mutations"))


def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are salient, or whose user shares an event payload with at least two others."""
    records = S.with_recurrence(triage(spark, sf_dir), event_signals(spark, sf_dir))
    return S.escalated(records).select("id", "salience", "recurrence")


def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions still to do when those with an even number of tool errors had been finished, others left pending."""
    stats = stash(session_stats(spark, sf_dir))
    journal = stats.select(F.col("session_id").alias("id"),
                           F.when(F.col("n_tool_errors") % 2 == 0, "ok").otherwise("pending").alias("status"))
    return S.untriaged(stats.select("session_id", "n_events"), journal)


def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = triage(spark, sf_dir)
    done = inputs.table(spark, sf_dir, "conversations").where("role = 'system'").select("conv_id").distinct()
    return S.triage_summary(records, done)


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.concat_ws(":", "event_type", "props").alias("signal"))


def recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads that several users share."""
    return S.recurrence(event_signals(spark, sf_dir))


def swept(spark: SparkSession, sf_dir: str) -> str:
    """The journal of three sweeps: over the lines at even places, over the others, and over nothing new.

    Sessions have lines in both, some lines are broken, and verdicts and replies come from elsewhere.
    """
    root = scratch(spark)
    lines = stash(derived.transcript_lines(spark, sf_dir).unionByName(derived.broken_lines(spark, sf_dir)))
    replies = stash(derived.replies(spark, sf_dir))
    for half in ("place % 2 = 0", "place % 2 = 1", None):
        if half:
            lines.where(half).select("session_id", F.col("line").alias("value")).write.mode("append").parquet(f"{root}/lines")
        read = sweep.line_stream(spark, f"{root}/lines")
        sweep.start(read, f"{root}/journal", f"{root}/checkpoint", verdicts=verdicts(spark, sf_dir), analyse=replies).awaitTermination()
    return f"{root}/journal"


def stream_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current record of every session: counts added up over batches."""
    return sweep.read_journal(spark, swept(spark, sf_dir)).select(
        "id", "status", "salience", "facts.events", "facts.human", "facts.tool_uses", "escalated", "error", "batch")


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that could not be read, and replies that could not be used, while the others were finished."""
    return sweep.read_quarantine(spark, swept(spark, sf_dir)).select("id", "stage", "error")


def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep.read_findings(spark, swept(spark, sf_dir))
    return found.select("id", "status", "root_cause", F.round("confidence", 2).alias("confidence"), F.size("artifacts").cast("long").alias("n_artifacts"))


def stream_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.read_artifacts(spark, swept(spark, sf_dir)).select("finding_id", "id", "type", "title", "status")


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of the sweeps did."""
    return sweep.read_summaries(spark, swept(spark, sf_dir)).drop("run")


SESSIONS: dict[str, Query] = {
    "session_stats": session_stats,
    "tool_topk": tool_topk,
    "corrections": corrections,
    "first_messages": first_messages,
    "session_excerpts": excerpts,
    "session_index": session_index,
    "salience": salience,
    "escalation": escalation,
    "pending_sessions": pending_sessions,
    "triage_summary": triage_summary,
    "recurrence": recurrence,
}

# --- conversations --------------------------------------------------------------------------------------------------


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.contract(inputs.table(spark, sf_dir, "conversations"))


def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.contract_errors(contract(spark, sf_dir))


def merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one side as one turn: the digest of their joined text, beside the counts and the digest of their pieces."""
    pieces = conversations.run_pieces(derived.two_sided_turns(spark, sf_dir))
    return conversations.digested_runs(pieces)


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as records of at least four messages: runs merged, the end without a reply dropped, tool calls spelled out."""
    records, _ = S.convert_transcripts(derived.plain_transcripts(spark, sf_dir), "own", min_turns=4)
    lengths = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))
    return records.select("conv_id", F.size("messages").cast("long").alias("n_messages"), lengths.alias("n_chars"),
                          F.element_at("messages", -1)["content"].alias("last"), "source", "notes")


def minimum_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the conversations with at least four messages."""
    merged = conversations.merge_turns(derived.two_sided_turns(spark, sf_dir))
    return conversations.to_records(merged, 4).select("conv_id", "n_messages", F.element_at("messages", -1)["role"].alias("last_role"))


def residual_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that hold an assignment once their turns are read one after the other; no turn holds one alone."""
    plain = F.regexp_replace("text", r"[^\p{L}\s]", "")
    ending = F.when(F.col("conv_id") % 3 == 0, " set the API_TOKEN").otherwise(" all done")
    beginning = F.when(F.col("conv_id") % 2 == 0, "= winterharbour99 ").otherwise("")
    text = (F.when(F.col("turn") == 0, F.concat(plain, ending)).when(F.col("turn") == 1, F.concat(beginning, plain)).otherwise(plain))
    turns = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return S.secret_windows(Grouped(turns, "conv_id"), "turn", "text", 400, 100).select("conv_id")


def trim_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trim_to_assistant(derived.turns(spark, sf_dir)).rows.select("conv_id", "turn", "role")


def valid_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed conversations that meet the contract, each with its fingerprint."""
    trimmed = conversations.trim_to_assistant(derived.turns(spark, sf_dir))
    checked = conversations.contract(trimmed.rows).where("first_error is null").select("conv_id")
    return conversations.fingerprints(trimmed).join(checked, "conv_id")


def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stash(valid_conversations(spark, sf_dir))
    return conversations.first_copies(entries, "conv_id").select("conv_id", "n_messages", "fingerprint", "status")


def conversation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_conversations(spark, sf_dir).select(
        "conv_id", conversations.split_of(F.col("fingerprint"), HOLD_OUT).alias("split"))


def document_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stash(derived.document_entries(spark, sf_dir))
    good = conversations.first_copies(entries.where("not bad"), "entry")
    return good.unionByName(entries.where("bad").withColumn("status", F.lit("bad"))).withColumn(
        "split", conversations.split_of(F.col("fingerprint"), HOLD_OUT))


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.source_stats(document_statuses(spark, sf_dir))


def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dataset_card(document_statuses(spark, sf_dir).where("status = 'written'"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split by their number, so that copies land on both sides; then the training side is cleaned."""
    entries = derived.document_entries(spark, sf_dir).withColumn(
        "split", conversations.split_of(F.col("entry").cast("string"), HOLD_OUT))
    entries = stash(entries)
    held_out = entries.where("split = 'eval'").select("fingerprint")
    kept, removed = conversations.decontaminate(entries.where("split = 'train'"), held_out)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_kept")).withColumn(
        "n_removed", removed.select("n_removed").scalar())


def answer_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: good ones must hold two common words, unlabelled ones anything."""
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = derived.documents(spark, sf_dir).join(labels, "doc_id", "left")
    expect = F.when(F.col("quality") == 1, F.array(F.lit("The"), F.lit("in"))).when(
        F.col("quality") == 0, F.array(F.lit("."), F.col("lang")))
    return conversations.score_answers(rows.select(F.col("text").alias("output"), expect.alias("expect")))


CONVERSATIONS: dict[str, Query] = {
    "conversation_contract": contract,
    "conversation_errors": contract_errors,
    "merge_turns": merge_turns,
    "residual_secrets": residual_secrets,
    "minimum_turns": minimum_turns,
    "convert_transcripts": converted,
    "trim_turns": trim_turns,
    "fingerprint_dedup": fingerprint_dedup,
    "conversation_split": conversation_split,
    "contamination": contamination,
    "dataset_card": dataset_card,
    "source_stats": source_stats,
    "answer_scoring": answer_scoring,
}

# --- audits ---------------------------------------------------------------------------------------------------------


def per_verdict(judged: DataFrame, *by: str) -> DataFrame:
    return judged.groupBy(*by, "decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def sql_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_verdict(audit.sql_audit(derived.statements(spark, sf_dir)))


def egress_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = ["shop.example.com", "m.ththth.example.net"]
    return per_verdict(audit.egress_audit(derived.requests(spark, sf_dir), hosts), "host")


def tool_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_verdict(audit.tool_audit(derived.tool_calls(spark, sf_dir), ALLOWED_HOSTS), "tool")


AUDITS: dict[str, Query] = {"sql_audit": sql_audit, "egress_audit": egress_audit, "tool_audit": tool_audit}

STREAMS: dict[str, Query] = {
    "stream_sweep": stream_sweep,
    "stream_quarantine": stream_quarantine,
    "stream_findings": stream_findings,
    "stream_artifacts": stream_artifacts,
    "stream_summary": stream_summary,
}

QUERIES: dict[str, Query] = {
    **MINING, **FINDINGS, **REGISTER, **LOADING, **READERS, **SESSIONS, **CONVERSATIONS, **AUDITS, **STREAMS,
}

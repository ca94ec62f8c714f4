"""The registered queries once more as SQL, written independently of the Spark operators."""

from __future__ import annotations

from casetrail import fixed_values as fixed
from casetrail.plans.derived import LEAKS, LETTERS, PLANTED
from casetrail.plans.queries import ANSWERS, FACTOR, REWORK

# --- logs -----------------------------------------------------------------------------------------------------------

JOB_LOG = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    CASE WHEN l_orderkey % 13 = 0 THEN l_linenumber ELSE 0 END, l_shipdate, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax) AS line_rank
  FROM lineitem),
log AS (
  SELECT 0 AS ingest_seq, 'job-' || o_orderkey AS case_id, 'Quote' AS activity, epoch_us(o_orderdate) AS us,
         'tech-' || (o_custkey % 8) AS resource, 'fsm' AS source_system, 'fsm.job.' || o_orderkey AS entity_fqn
  FROM orders
  UNION ALL
  SELECT 1, 'job-' || o_orderkey, 'QuoteApproved', epoch_us(o_orderdate) + 3600000000, 'tech-' || (o_orderkey % 8),
         'fsm', 'fsm.job.' || o_orderkey
  FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL
  SELECT 1 + line_rank, 'job-' || l_orderkey,
         CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'Scheduled' WHEN 'NF' THEN 'Attended'
           WHEN 'AO' THEN 'JobComplete' WHEN 'AF' THEN 'Invoice' WHEN 'RO' THEN 'DefectRaised'
           WHEN 'RF' THEN 'RectifyComplete' END,
         greatest(epoch_us(l_shipdate), epoch_us(o_orderdate) + 7200000000), 'tech-' || (l_suppkey % 8),
         CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 'finance' ELSE 'fsm' END,
         CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 'finance.invoice.' ELSE 'fsm.job.' END || l_orderkey
  FROM ranked JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 0, 'svc-' || l_orderkey || '-' || line_rank, 'RoutineService', epoch_us(l_shipdate),
         'tech-' || (l_suppkey % 8), 'compliance', 'asset.' || l_partkey
  FROM ranked JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45)"""

WEB_LOG = """
log AS (
  SELECT event_id AS ingest_seq, user_id::VARCHAR AS case_id, event_type AS activity, epoch_us(ts) AS us,
         '' AS resource, 'web' AS source_system, 'web.user.' || user_id AS entity_fqn
  FROM events)"""

SLICES = " || '-' || ".join(
    f"lower(to_hex(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::BIGINT))" for i in range(4))


def marked(value: str) -> str:
    """A text with its length before it, NULL as a dash."""
    return f"coalesce(length({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


MEASURES = """,
nexts AS (
  SELECT case_id, activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY us, ingest_seq) AS dst FROM log),
dfg AS (SELECT src, dst, count(*) AS n FROM nexts WHERE dst IS NOT NULL GROUP BY src, dst),
recorded AS (
  SELECT case_id, activity AS src, lead(activity) OVER w AS dst, lead(us) OVER w - us AS gap FROM log
  WINDOW w AS (PARTITION BY case_id ORDER BY ingest_seq)),
bad AS (SELECT case_id, count(*) AS n_errors FROM recorded WHERE gap < 0 GROUP BY case_id),
dur AS (
  SELECT src, dst, count(*) AS n, sum(gap)::BIGINT AS total_us, sum(gap)::BIGINT / count(*) / 1000000 AS mean_s
  FROM recorded WHERE dst IS NOT NULL AND case_id NOT IN (SELECT case_id FROM bad) GROUP BY src, dst),
per_case AS (SELECT case_id, activity, count(*) AS n FROM log GROUP BY case_id, activity),
cases AS (SELECT count(DISTINCT case_id) AS n FROM log),
placed AS (
  SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY us, ingest_seq) AS position FROM log),
sequences AS (
  SELECT case_id, count(*) AS length, count(*) || '-' || %s AS variant
  FROM (SELECT case_id, sha256(%s || %s) AS h FROM placed) GROUP BY case_id)"""


def over(log: str, query: str) -> str:
    return f"WITH {log}{MEASURES % (SLICES, marked('position'), marked('activity'))}\n{query}"


def jobs(query: str) -> str:
    return over(JOB_LOG, query)


MINING = {
    "activity_frequency": "SELECT activity, count(*) AS n FROM log GROUP BY activity",
    "dfg": "SELECT src, dst, n FROM dfg",
    "selfloops": "SELECT src AS activity, n FROM dfg WHERE src = dst",
    "rework": "SELECT activity, count(*) AS n_cases FROM per_case WHERE n > 1 GROUP BY activity",
    "throughput": "SELECT case_id, max(us) - min(us) AS throughput_us FROM log GROUP BY case_id",
    "transition_durations": "SELECT src, dst, n, total_us, round(mean_s, 3) AS mean_s FROM dur",
    "coverage": """
SELECT activity, count(*) AS n_cases, (SELECT n FROM cases) AS total_cases,
       round(count(*) / (SELECT n FROM cases), 6) AS coverage
FROM per_case GROUP BY activity""",
    "recording_errors": "SELECT case_id, n_errors FROM bad",
    "variants": """
SELECT variant, length, count(*) AS n_cases, min(case_id) AS example_case FROM sequences GROUP BY variant, length""",
    "variant_steps": """
, examples AS (SELECT variant, min(case_id) AS case_id FROM sequences GROUP BY variant)
SELECT variant, position, activity FROM placed JOIN examples USING (case_id)""",
    "dfg_fitness": """
, known AS (SELECT src, dst FROM dur WHERE total_us < n * 20 * 86400000000),
shares AS (
  SELECT case_id, CASE WHEN count(nexts.dst) = 0 THEN 1.0
    ELSE count(known.dst)::DOUBLE / count(nexts.dst) END AS share
  FROM nexts LEFT JOIN known ON nexts.src = known.src AND nexts.dst = known.dst GROUP BY case_id)
SELECT count(*) AS n_cases, round(avg(share), 6) AS fitness FROM shares""",
    "log_summary": f"""
SELECT 'n_cases' AS section, '' AS key, n::DOUBLE AS value FROM cases
UNION ALL SELECT 'activity_frequency', activity, count(*) FROM log GROUP BY activity
UNION ALL SELECT 'activity_case_coverage', activity, round(count(*) / (SELECT n FROM cases), 3)
  FROM per_case GROUP BY activity
UNION ALL SELECT * FROM (SELECT 'slow_transitions', src || '->' || dst, round(mean_s, 1) FROM dur
  ORDER BY mean_s DESC, src, dst LIMIT {fixed.SUMMARY_SLOWEST})
UNION ALL SELECT 'rework_cases_by_activity', activity, count(*) FROM per_case WHERE n > 1 GROUP BY activity
UNION ALL SELECT 'cases_with_recording_errors', '', count(*) FROM bad""",
}

WEB = {f"web_{name}": over(WEB_LOG, MINING[name]) for name in (
    "activity_frequency", "dfg", "throughput", "transition_durations", "coverage")}

# --- detectors ------------------------------------------------------------------------------------------------------

COUNTS = """,
flags AS (
  SELECT case_id, bool_or(activity = 'JobComplete') AS completed, bool_or(activity = 'Invoice') AS invoiced,
         bool_or(activity = 'QuoteApproved') AS approved, bool_or(activity = 'DefectRaised') AS defect,
         bool_or(activity = 'RectifyComplete') AS rectified, count(*) FILTER (activity = 'Attended') AS visits,
         bool_or(activity IN ('Invoice', 'Paid') AND source_system = 'finance') AS billed,
         bool_or(activity = 'JobComplete' AND source_system = 'fsm') AS delivered
  FROM log GROUP BY case_id),
counts AS (
  SELECT count(*) AS n_cases, count(*) FILTER (completed) AS completed,
         count(*) FILTER (completed AND NOT invoiced) AS unbilled, count(*) FILTER (defect) AS defects,
         count(*) FILTER (defect AND NOT rectified) AS stalled, count(*) FILTER (invoiced) AS invoiced,
         count(*) FILTER (invoiced AND NOT approved) AS no_approval, count(*) FILTER (visits > 1) AS repeat_visits,
         count(*) FILTER (billed) AS billed, count(*) FILTER (billed AND NOT delivered) AS orphans
  FROM flags),
services AS (
  SELECT entity_fqn, greatest(max(us), 0) AS last_us,
         (SELECT max(us) FROM log) - greatest(max(us), 0) > 396 * 86400000000 AS overdue
  FROM log WHERE activity = 'RoutineService' AND entity_fqn <> '' GROUP BY entity_fqn),
assets AS (SELECT count(*) AS assets, count(*) FILTER (overdue) AS overdue FROM services),
firsts AS (
  SELECT case_id, activity, arg_min(resource, ingest_seq) AS resource FROM log
  WHERE activity IN ('Quote', 'QuoteApproved') GROUP BY case_id, activity),
same_person AS (
  SELECT count(*) AS jobs FROM firsts q JOIN firsts a ON q.case_id = a.case_id AND q.resource = a.resource
  WHERE q.activity = 'Quote' AND a.activity = 'QuoteApproved' AND q.resource <> ''),
bad_list AS (SELECT to_json(list(case_id ORDER BY case_id))::VARCHAR AS cases FROM (
  SELECT case_id FROM bad ORDER BY case_id LIMIT 20))"""


def detection(order: int, kind: str, key: str, title: str, frequency: str, metric: str, value: str, evidence: str,
              source: str, severity: str | None = None) -> str:
    fixed_severity, fixability = fixed.DETECTOR_SCORES[kind]
    severity = f"round({severity}, 3)" if severity else f"{fixed_severity}::DOUBLE"
    return f"""
SELECT {order} AS detector_order, '{kind}' AS kind, {title} AS title, {key} AS key, {severity} AS severity,
       round({frequency}, 3) AS frequency, {fixability}::DOUBLE AS fixability,
       round(round({frequency}, 3) * {severity} * {fixability}::DOUBLE, 4) AS score,
       'metric.{kind}.' || {key} AS evidence_fqn, 1.0::DOUBLE AS confidence, '{metric}' AS metric_name,
       round(({value})::DOUBLE, 3) AS metric_value, {evidence} AS evidence_json
FROM {source}"""


def slow(order: int, kind: str, title: str, metric: str, where: str, keep: str = "") -> str:
    source = f"""(
  SELECT d.src || '->' || d.dst AS step, d.mean_s, d.mean_s / (SELECT max(mean_s) FROM dur WHERE {where}) AS severity,
         f.n AS n_steps, f.n / (SELECT sum(n) FROM dfg) AS frequency
  FROM dur d JOIN dfg f ON d.src = f.src AND d.dst = f.dst
  WHERE {where.replace('src', 'd.src').replace('dst', 'd.dst')}
    AND d.mean_s >= {FACTOR} * (SELECT median(mean_s) FROM dur WHERE {where})
  {keep})"""
    evidence = """'{"transition":"' || step || '","n":' || n_steps || '}'"""
    return detection(order, kind, "step", f"'{title}' || step", "frequency", metric, "mean_s", evidence, source,
                     severity="severity")


def rate(order: int, kind: str, key: str, title: str, part: str, whole: str, metric: str, evidence: str, floor: float,
         table: str = "counts") -> str:
    return detection(order, kind, f"'{key}'", title, f"{part} / {whole}", metric, part, evidence,
                     f"{table} WHERE {part} / {whole} > {floor}")


def pair(first: str, second: str) -> str:
    return f"""'{{"{first}":' || {first} || ',"{second}":' || {second} || '}}'"""


JOB_FLOW = "src IN ({0}) AND dst IN ({0})".format(", ".join(f"'{a}'" for a in fixed.JOB_FLOW))
ACTIVITY = """(SELECT activity, count(*) FILTER (n > 1) AS n_repeat, count(*) / (SELECT n FROM cases) AS coverage,
  count(*) FILTER (n > 1) / (SELECT n FROM cases) AS share FROM per_case GROUP BY activity)"""
NAMED = """'{"activity":"' || activity || '"}'"""


def recording(order: int) -> str:
    return detection(order, "recording-error", "'log'", "'Out-of-order timestamps in the log'",
                     "n_bad / n", "cases_with_recording_errors", "n_bad",
                     """'{"cases":' || (SELECT cases FROM bad_list) || '}'""",
                     "(SELECT (SELECT count(*) FROM bad) AS n_bad, n FROM cases) WHERE n_bad > 0")


DETECT = {
    "bottlenecks": slow(1, "bottleneck", "Bottleneck at ", "bottleneck_mean_duration", "true"),
    "slowest_ten": slow(1, "bottleneck", "Bottleneck at ", "bottleneck_mean_duration", "true",
                        f"ORDER BY d.mean_s DESC, d.src, d.dst LIMIT {fixed.BOTTLENECK_KEEP}"),
    "rework_findings": detection(
        2, "rework", "activity", "'Rework loop on ' || activity", "share", "rework_case_count", "n_repeat", NAMED,
        f"{ACTIVITY} WHERE share >= {REWORK}"),
    "control_gaps": detection(
        3, "control-gap", "activity",
        "activity || ' skipped in ' || round((1 - coverage) * 100, 0)::BIGINT || '% of cases'", "(1 - coverage)",
        "activity_coverage", "coverage", NAMED,
        f"{ACTIVITY} WHERE coverage >= {fixed.CONTROL_GAP_LOW} AND coverage < {fixed.CONTROL_GAP_HIGH}"),
    "recording_error_finding": recording(4),
    "unbilled_completion": rate(
        1, "unbilled-completion", "JobComplete", "unbilled || ' completed jobs never invoiced'", "unbilled", "completed",
        "unbilled_completed_jobs", pair("completed", "unbilled"), fixed.RATE_FLOOR),
    "rectification_stall": rate(
        2, "rectification-stall", "DefectRaised", "stalled || ' raised defects never rectified'", "stalled", "defects",
        "stalled_rectifications", pair("defects", "stalled"), fixed.RATE_FLOOR),
    "compliance_overdue": rate(
        3, "compliance-overdue", "RoutineService", "overdue || ' assets overdue for AS 1851 routine service'", "overdue",
        "assets", "overdue_compliance_assets",
        """'{"assets_with_service":' || assets || ',"overdue":' || overdue || ',"interval_days":365}'""", 0, "assets"),
    "approval_gap": rate(
        4, "approval-gap", "QuoteApproved", "no_approval || ' jobs invoiced without a recorded approval'", "no_approval",
        "invoiced", "invoiced_without_approval", pair("invoiced", "no_approval"), fixed.RATE_FLOOR),
    "rework_loop": rate(
        5, "rework-loop", "Attended", "'Repeat site visits on ' || repeat_visits || ' jobs'", "repeat_visits", "n_cases",
        "repeat_attendance_cases", """'{"activity":"Attended"}'""", fixed.RATE_FLOOR),
    "dispatch_bottleneck": slow(6, "dispatch-bottleneck", "Dispatch bottleneck at ", "transition_mean_duration",
                                JOB_FLOW),
    "segregation_of_duties": rate(
        7, "segregation-of-duties", "Quote/QuoteApproved", "jobs || ' jobs quoted and approved by the same person'",
        "jobs", "n_cases", "self_approved_jobs", """'{"jobs":' || jobs || '}'""", fixed.SMALL_RATE_FLOOR,
        "(SELECT jobs, n_cases FROM same_person, counts)"),
    "cross_source_orphan": rate(
        8, "cross-source-orphan", "Invoice", "orphans || ' jobs billed in finance with no field-service completion'",
        "orphans", "billed", "billed_without_delivery", pair("billed", "orphans"), fixed.SMALL_RATE_FLOOR),
}

COLUMNS = ("detector_order, kind, title, key, severity, frequency, fixability, score, evidence_fqn, confidence")
GENERIC = "\nUNION ALL".join(DETECT[n] for n in (
    "bottlenecks", "rework_findings", "control_gaps", "recording_error_finding")).replace(
    f"share >= {REWORK}", f"share >= {fixed.REWORK_SHARE}")
FIELD_SERVICE = "\nUNION ALL".join([*[DETECT[n] for n in (
    "unbilled_completion", "rectification_stall", "compliance_overdue", "approval_gap", "rework_loop",
    "dispatch_bottleneck", "segregation_of_duties", "cross_source_orphan")], recording(9)])


def counted(query: str) -> str:
    return jobs(f"{COUNTS}\n{query}")


def detected(query: str) -> str:
    """Over ``found``, the field-service detections."""
    return jobs(f"{COUNTS},\nfound AS ({FIELD_SERVICE})\n{query}")


FINDINGS = {name: counted(f"SELECT {COLUMNS}, metric_name, metric_value FROM ({sql})") for name, sql in DETECT.items()}
FINDINGS |= {
    "generic_register": counted(f"SELECT {COLUMNS} FROM ({GENERIC})"),
    "case_counts": counted("SELECT * FROM counts"),
    "asset_services": counted("SELECT * FROM services"),
    "cross_source_orphan_cases": counted("SELECT case_id FROM flags WHERE billed AND NOT delivered"),
    "field_service_register": detected(f"SELECT {COLUMNS} FROM found"),
    "field_service_metrics": detected(
        "SELECT evidence_fqn AS fqn, metric_name AS name, metric_value AS value, evidence_json FROM found"),
    "detect_and_store": detected(
        "SELECT evidence_fqn AS fqn, any_value(metric_name) AS name, any_value(metric_value) AS value, 2 * count(*) AS n_findings "
        "FROM found GROUP BY evidence_fqn"),
}

# --- registers ------------------------------------------------------------------------------------------------------

ENTITIES = """
  SELECT 'crm.customer.' || c_custkey AS fqn, 'customer' AS kind, c_name AS name, 'crm' AS source_system FROM customer
  UNION ALL SELECT 'erp.supplier.' || s_suppkey, 'supplier', s_name, 'erp' FROM supplier
  UNION ALL SELECT 'erp.part.' || p_partkey, 'part', p_name, 'erp' FROM part"""
CITABLE = f"""
citable AS (
  SELECT fqn FROM ({ENTITIES}) UNION SELECT entity_fqn FROM log WHERE entity_fqn <> '')"""
NAIVE_STEP = """
SELECT 0 AS detector_order, 'dispatch-bottleneck' AS kind, 'Frequent transition ' || src || '->' || dst AS title,
       src || '->' || dst AS key, 0.5::DOUBLE AS severity, 0.5::DOUBLE AS frequency, 0.5::DOUBLE AS fixability,
       0.125::DOUBLE AS score, (SELECT arg_min(entity_fqn, (case_id, ingest_seq)) FROM log WHERE entity_fqn <> '')
       AS evidence_fqn, 1.0::DOUBLE AS confidence
FROM (SELECT src, dst FROM dfg ORDER BY n DESC, src, dst LIMIT 1)"""
KEY = ", ".join(f"('{kind}', '{key}')" for kind, key in ANSWERS)


def grade(rows: str) -> str:
    """CTEs that grade ``rows``: per population tp, fp, fn, precision, recall, f1."""
    return f"""
answer AS (SELECT * FROM (VALUES {KEY}) AS t(kind, key)),
flagged AS (
  SELECT *, evidence_fqn IN (SELECT fqn FROM citable) AS grounded FROM ({rows})),
populations AS (
  SELECT 'ungated' AS population, * FROM flagged UNION ALL SELECT 'gated', * FROM flagged WHERE grounded),
firsts_per_key AS (
  SELECT population, lower(trim(key)) AS k, arg_min(kind, (-score, detector_order, key, kind)) AS kind FROM populations
  GROUP BY population, lower(trim(kind)), lower(trim(key))),
matched AS (
  SELECT population, count(*) FILTER (EXISTS (
           SELECT 1 FROM answer a WHERE a.kind = f.kind AND lower(trim(a.key)) = f.k)) AS tp, count(*) AS n
  FROM firsts_per_key f GROUP BY population),
tallies AS (
  SELECT p.population, coalesce(tp, 0) AS tp, coalesce(n - tp, 0) AS fp,
         (SELECT count(*) FROM answer) - coalesce(tp, 0) AS fn
  FROM (VALUES ('ungated'), ('gated')) AS p(population) LEFT JOIN matched USING (population)),
rates AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM tallies),
graded AS (
  SELECT population, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall,
         round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1,
         (SELECT count(*) FROM flagged) AS n_findings,
         (SELECT round(count(*) FILTER (NOT grounded) / count(*), 4) FROM flagged) AS hallucination_rate
  FROM rates)"""


WITH_METRICS = CITABLE.replace("WHERE entity_fqn <> '')", "WHERE entity_fqn <> '' UNION SELECT evidence_fqn FROM found)")
BAND = ("CASE WHEN severity >= 0.8 THEN 'Critical' WHEN severity >= 0.6 THEN 'High' "
        "WHEN severity >= 0.4 THEN 'Medium' ELSE 'Low' END")
ADVICE = "CASE kind {} ELSE '{}' END".format(
    " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in fixed.PLAYBOOK.items()),
    fixed.PLAYBOOK_DEFAULT)
RANKED = f"""
SELECT row_number() OVER (ORDER BY score DESC, detector_order, key) AS rank, {BAND} AS priority, kind, title, score,
       {ADVICE} AS recommendation, severity, frequency, evidence_fqn FROM found"""
COPIED = f"""
SELECT {COLUMNS} FROM found
UNION ALL SELECT detector_order + 100, kind, title, upper(key), severity, frequency, fixability, score, evidence_fqn,
  confidence FROM found
UNION ALL SELECT detector_order, 'approval-gap', title, 'Nowhere', severity, frequency, fixability, score, 'metric.none',
  confidence FROM found WHERE kind = 'rework-loop'"""

REGISTER = {
    "naive_baseline": jobs("""
, top AS (SELECT activity, count(*) AS n FROM log GROUP BY activity ORDER BY n DESC, activity LIMIT 1),
cited AS (
  SELECT top.*, (SELECT arg_min(entity_fqn, (case_id, ingest_seq)) FROM log
                 WHERE entity_fqn <> '' AND activity = top.activity) AS fqn,
         n / (SELECT count(*) FROM log) AS frequency FROM top)
SELECT 0 AS detector_order, 'bottleneck' AS kind, 'High-volume activity ' || activity AS title, activity AS key,
       0.5::DOUBLE AS severity, frequency, 0.5::DOUBLE AS fixability, round(frequency * 0.25::DOUBLE, 4) AS score,
       fqn AS evidence_fqn, 1.0::DOUBLE AS confidence FROM cited
UNION ALL
SELECT 0, 'rework', 'Frequent ' || activity, activity, 0.5, 0.5, 0.5, 0.125, fqn, 1.0 FROM cited
WHERE n / (SELECT n FROM cases) > 1"""),
    "naive_field_service_baseline": jobs(NAIVE_STEP),
    "citation_gate": jobs(f""",{CITABLE},
claims AS (
  SELECT 'customer' AS kind, 'crm.customer.' || (c_custkey * 2) AS fqn FROM customer
  UNION ALL SELECT 'orders', 'fsm.job.' || (o_orderkey * 2) FROM orders
  UNION ALL SELECT 'part', 'asset.' || p_partkey FROM part UNION ALL SELECT 'nation', '' FROM nation)
SELECT kind, count(*) AS n, count(*) FILTER (fqn IN (SELECT fqn FROM citable)) AS n_grounded FROM claims GROUP BY kind"""),
    "first_entities": jobs("SELECT DISTINCT entity_fqn AS fqn FROM log WHERE entity_fqn <> '' ORDER BY fqn LIMIT 8"),
    "safety_net": detected(f"""
, accepted AS (
  SELECT kind, key, 'Checked: ' || title AS title, least(1.0, severity + 0.5) AS severity,
         CASE WHEN key = 'Invoice' THEN 0.5 ELSE frequency END AS frequency, evidence_fqn
  FROM found WHERE detector_order % 2 = 0)
SELECT 0 AS detector_order, kind, title, key, severity, frequency, 0.0::DOUBLE AS fixability, 0.0::DOUBLE AS score,
       evidence_fqn, 1.0::DOUBLE AS confidence FROM accepted
UNION ALL
SELECT {COLUMNS} FROM found WHERE (kind, key) NOT IN (SELECT (kind, key) FROM accepted)"""),
    "grade_register": detected(f",{WITH_METRICS},{grade(COPIED)}\nSELECT * FROM graded"),
    "rel_error_reduction": detected(f""",{WITH_METRICS},{grade(f"SELECT {COLUMNS} FROM found")},
first_step AS ({NAIVE_STEP}),
naive AS (SELECT CASE WHEN EXISTS (
    SELECT 1 FROM answer a, first_step f WHERE a.kind = f.kind AND lower(trim(a.key)) = lower(trim(f.key)))
  THEN 1.0 / 1 ELSE 0.0 END AS p),
naive_f1 AS (SELECT round(CASE WHEN p > 0 THEN 2 * p * 0.1 / (p + 0.1) ELSE 0 END, 4)::DOUBLE AS f FROM naive)
SELECT population, f1, f AS baseline_f1, CASE WHEN f >= 1 THEN 0 ELSE round((f1 - f) / (1 - f), 4) END
       AS rel_error_reduction, round(f1 - f, 4) AS abs_f1_delta FROM graded, naive_f1"""),
    "entity_upsert": f"""
SELECT e.fqn, e.kind, CASE WHEN c.c_custkey IS NULL THEN e.name ELSE e.name || ' (second)' END AS name, e.source_system
FROM ({ENTITIES}) e LEFT JOIN customer c ON e.fqn = 'crm.customer.' || c.c_custkey AND c.c_acctbal < 0
UNION ALL SELECT 'erp.nation.' || n_nationkey, 'nation', n_name, 'erp' FROM nation""",
    "metric_upsert": """
WITH every AS (
  SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f, count(*) FILTER (o_orderstatus = 'O') AS open_n,
         min(o_orderkey) FILTER (o_orderstatus = 'O') AS open_f FROM orders GROUP BY o_custkey)
SELECT 'metric.orders.' || o_custkey AS fqn, CASE WHEN open_n > 0 THEN 'open_orders' ELSE 'all_orders' END AS name,
       (CASE WHEN open_n > 0 THEN open_n ELSE n END)::DOUBLE AS value,
       '{"orders":' || CASE WHEN open_n > 0 THEN open_n ELSE n END || ',"first":' ||
         CASE WHEN open_n > 0 THEN open_f ELSE f END || '}' AS evidence_json
FROM every""",
    "report_ranked": detected(f"SELECT rank, priority, kind, title, score, recommendation FROM ({RANKED})"),
    "report_lines": detected(f""", ranked_rows AS ({RANKED})
SELECT 0 AS part, 0 AS rank, i AS line_no, t AS line FROM (VALUES
  (0, '{fixed.REPORT_TITLE}field service'), (1, '')) AS v(i, t)
UNION ALL SELECT 1, 0, i, t FROM (VALUES
  (0, (SELECT count(*) FROM found) || ' findings, ordered by impact (frequency x severity x fixability).'), (1, ''),
  (2, '| # | Priority | Finding | Score |'), (3, '|---|---|---|---|')) AS v(i, t)
UNION ALL SELECT 2, rank, 0, '| ' || rank || ' | ' || priority || ' | ' || title || ' | ' || score || ' |'
  FROM ranked_rows
UNION ALL SELECT 3, 0, 0, ''
UNION ALL SELECT 4, rank, 0, '### ' || rank || '. ' || title FROM ranked_rows
UNION ALL SELECT 4, rank, 1, '- Priority: ' || priority || ' (severity ' || severity || ', frequency ' || frequency ||
  ')' FROM ranked_rows
UNION ALL SELECT 4, rank, 2, '- Evidence: `' || evidence_fqn || '`' FROM ranked_rows
UNION ALL SELECT 4, rank, 3, '- Recommendation: ' || recommendation FROM ranked_rows
UNION ALL SELECT 4, rank, 4, '' FROM ranked_rows"""),
}

PROPOSALS = """
SELECT left(sha256(p_partkey || '|' || type || '|' || title || '|' || p_type), 12) AS id, type, title,
       CASE WHEN type IN ('script', 'skill') THEN 'queue' ELSE 'auto' END AS route
FROM (SELECT *, trim(p_name)[:120] AS title, CASE p_type WHEN 'ECONOMY' THEN 'script' WHEN 'STANDARD' THEN 'lesson'
        WHEN 'PROMO' THEN 'skill' ELSE 'memo' END AS type FROM part) WHERE type <> 'memo'"""
REGISTER |= {
    "proposal_ids": PROPOSALS,
    "proposal_index": f"""
SELECT CASE route WHEN 'queue' THEN 'pending' ELSE 'written' END AS status, count(DISTINCT id) AS n
FROM ({PROPOSALS}) GROUP BY 1""",
    "pending_proposals": f"SELECT DISTINCT id, type, title FROM ({PROPOSALS}) WHERE route = 'queue'",
}

# --- loading and scrubbing ------------------------------------------------------------------------------------------


def text_rule(pattern: str, shown: str, table: str = "documents") -> str:
    return f"""
SELECT doc_id, len(regexp_extract_all(text, {pattern})) AS n_hits,
       sha256(regexp_replace(text, {pattern}, '{shown}', 'g')) AS digest
FROM {table} WHERE regexp_matches(text, {pattern})"""


def sql_pattern(kind: str) -> str:
    _, pattern, flags, _ = next(rule for rule in fixed.CREDENTIAL_RULES if rule[0] == kind)
    prefix = f"(?{flags})" if flags else ""
    return "'" + prefix + pattern.replace("'", "''") + "'"


LOADING = {
    "canonical_status": """
SELECT CASE WHEN l_linenumber = 7 THEN 'Custom Step' ELSE CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'Scheduled'
         WHEN 'NF' THEN 'Attended' WHEN 'AO' THEN 'JobComplete' WHEN 'AF' THEN 'Invoice' WHEN 'RO' THEN 'DefectRaised'
         WHEN 'RF' THEN 'RectifyComplete' END END AS activity, count(*) AS n
FROM lineitem GROUP BY 1""",
    "parse_timestamps": """
SELECT o_orderkey % 8 AS shape, count(*) AS n, CASE WHEN o_orderkey % 8 >= 6 THEN 0 ELSE count(*) END AS n_parsed,
       sum(CASE o_orderkey % 8 WHEN 1 THEN epoch_ms(o_orderdate) + 250 WHEN 4 THEN epoch_ms(o_orderdate) - 19800000
         WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE epoch_ms(o_orderdate) END)::BIGINT AS sum_ms
FROM orders GROUP BY 1""",
    "event_normalise": """
SELECT o_orderkey AS ingest_seq, sha256('pepper' || 'J' || o_orderkey) AS case_id,
       CASE o_orderstatus WHEN 'O' THEN 'QuoteApproved' WHEN 'F' THEN 'Paid' WHEN 'P' THEN 'on hold' END AS activity,
       epoch_us(o_orderdate) AS us, 'desk ' || o_orderpriority AS resource, 'fsm' AS source_system,
       CASE WHEN o_orderstatus = 'P' THEN 'crm.deal.' || o_orderpriority
         ELSE 'fsm.job.' || sha256('pepper' || 'J' || o_orderkey) END AS entity_fqn
FROM orders""",
    "scrub_email": text_rule(sql_pattern("email"), "[REDACTED:email]"),
    "scrub_assignment": text_rule(sql_pattern("secret-assignment"), "\\1[REDACTED:secret-assignment]"),
    "scrub_private_ip": text_rule(sql_pattern("private-ip"), "[REDACTED:private-ip]", """(
  SELECT doc_id, text || ' from 10.' || (doc_id % 200) || '.3.4 or 172.20.1.' || (doc_id % 90) AS text FROM documents)"""),
    "scrub_rules": "SELECT doc_id, kind, 'seen: ' || left_over || ' - noted' AS text, '{\"' || kind || '\":1}' AS counts FROM (" +
    "SELECT doc_id, CASE doc_id % {0} {1} END AS kind, CASE doc_id % {0} {2} END AS left_over FROM documents)".format(
        len(PLANTED), " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(PLANTED)),
        " ".join(f"WHEN {i} THEN {left}" for i, (_, left) in enumerate(PLANTED.values()))),
}

EVENT_LINES = "SELECT event_id, event_type, props, user_id::VARCHAR AS user_id FROM events"
MESSAGES = """
WITH entries AS (
  SELECT doc_id % 2 AS side, {body} AS body, lang FROM documents),
firsts AS (SELECT DISTINCT body, lang FROM entries WHERE side = 0 AND body <> ''),
counted AS (
  SELECT CASE side WHEN 0 THEN 'even' ELSE 'odd' END AS source, body = '' AS bad, body, lang, count(*) AS n,
         side = 1 AND EXISTS (FROM firsts f WHERE f.body = e.body AND f.lang = e.lang) AS seen
  FROM entries e GROUP BY side, body, lang),
statuses AS (
  SELECT source, CASE WHEN bad THEN n ELSE 0 END AS bad, CASE WHEN bad OR seen THEN 0 ELSE 1 END AS written,
         CASE WHEN bad THEN 0 WHEN seen THEN n ELSE n - 1 END AS duplicate FROM counted)
SELECT source, status, sum(n)::BIGINT AS n FROM (
  UNPIVOT statuses ON bad, written, duplicate INTO NAME status VALUE n) GROUP BY source, status HAVING sum(n) > 0"""
EXPORTED = """
SELECT sha256('pepper' || 'J' || o_orderkey) AS case_id,
       CASE o_orderstatus WHEN 'O' THEN 'QuoteApproved' WHEN 'F' THEN 'Paid' WHEN 'P' THEN 'on hold' END AS activity,
       epoch_us(o_orderdate) AS us, 'desk' || CASE WHEN %s THEN chr(10) ELSE ' ' END || o_orderpriority AS resource,
       'fsm.job.' || sha256('pepper' || 'J' || o_orderkey) AS entity_fqn
FROM orders"""
READERS = {
    "csv_export": EXPORTED % "o_orderstatus = 'F'",
    "json_export": EXPORTED % "false",
    "jsonl_rows": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "xes_log": """
SELECT src, dst, count(*) AS n FROM (
  SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
WHERE dst IS NOT NULL GROUP BY src, dst""",
    "event_normalise_scrubbed": """
SELECT o_orderkey AS ingest_seq, 'J' || o_orderkey AS case_id,
       CASE o_orderstatus WHEN 'O' THEN 'QuoteApproved' WHEN 'F' THEN 'Paid' WHEN 'P' THEN 'on hold' END AS activity
FROM orders""",
    "session_index_files": f"""
SELECT user_id AS session_id, arg_max(props, event_id) AS cwd, arg_max(event_type, event_id) AS reason
FROM ({EVENT_LINES}) GROUP BY user_id""",
}

# --- sessions -------------------------------------------------------------------------------------------------------

SPACE = r"[\s\x1c-\x1f\x0b]"
FLAT = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"
STRIPPED = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
CORRECTION = r"(?i)^\s*((no|stop|wrong|don''?t|do not|actually|instead|undo|revert|that''?s not|not what)([^\p{L}\p{N}_]|$))"
INJECTED = """(regexp_matches(low, '^(base directory for this skill:|stop hook feedback:|caveat:|\\[request interrupted)')
  OR contains(low[:400], '<command-name>') OR contains(low[:400], '<command-message>')
  OR contains(low[:400], '<system-reminder>') OR contains(low[:400], '<local-command-stdout>')
  OR regexp_matches(low, '^#\\s+\\w[\\w /+.-]{0,40}\\bskill\\b'))"""
TRANSCRIPT = f"""
said AS (
  SELECT conv_id::VARCHAR AS session_id, turn AS place, role, text, {FLAT} AS flat,
         lower(regexp_replace(text, '^{SPACE}+', '')) AS low
  FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'user' ELSE role END AS role,
          CASE WHEN role = 'system' THEN 'Actually, ' || text WHEN role = 'user' AND turn = 4 THEN '<command-name>' || text
            ELSE text END AS text FROM conversations)),
lines AS (
  SELECT session_id, place, role = 'assistant' AS agent, NULL AS tool, false AS failed, flat, text,
         role = 'user' AND {STRIPPED} <> '' AND {INJECTED} AS injected,
         role = 'user' AND {STRIPPED} <> '' AND NOT {INJECTED} AS human FROM said
  UNION ALL
  SELECT user_id::VARCHAR, event_id + 1000000, event_type <> 'error',
         CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Bash' WHEN 'purchase' THEN 'Edit'
           WHEN 'signup' THEN 'Write' END, event_type = 'error', '', '', false, false FROM events),
stats AS (
  SELECT session_id, count(*) AS n_events, count(*) FILTER (human) AS n_user_msgs,
         count(*) FILTER (injected) AS n_injected, count(*) FILTER (agent) AS n_assistant_msgs,
         count(*) FILTER (failed) AS n_tool_results, count(*) FILTER (failed) AS n_tool_errors,
         count(tool) AS n_tool_uses, count(*) FILTER (tool IN ('Edit', 'Write')) AS n_mutations,
         count(*) FILTER (human AND regexp_matches(text, '{CORRECTION}')) AS n_corrections
  FROM lines GROUP BY session_id),
scored AS (
  SELECT *, round(least(1.0, least(0.5, 0.25 * n_corrections) + least(0.3, 0.08 * n_tool_errors)
           + least(0.15, 0.01 * n_mutations)
           + CASE WHEN n_user_msgs = 0 AND n_assistant_msgs > 20 THEN 0.1 ELSE 0.0 END), 2)::DOUBLE AS salience,
         session_id IN (SELECT conv_id::VARCHAR FROM conversations WHERE role = 'system') AS judged
  FROM stats)"""


def sessions(query: str) -> str:
    return f"WITH {TRANSCRIPT}\n{query}"


def digest(*parts: str) -> str:
    """The order-free digest of the rows of a group, with the number of rows before it."""
    marked = " || ".join(f"coalesce(length({p}::VARCHAR) || ':' || {p}, '-')" for p in parts)
    sums = [f"printf('%x', sum(('0x' || substr(sha256({marked}), {1 + 8 * i}, 8))::BIGINT)::BIGINT)" for i in range(4)]
    return f"concat_ws('-', count(*)::VARCHAR, {', '.join(sums)})"


def cut(n: int) -> str:
    return f"CASE WHEN length(flat) <= {n} THEN flat ELSE left(flat, {n - 1}) || '…' END"


SESSIONS = {
    "session_stats": sessions("SELECT * FROM stats"),
    "tool_topk": sessions("""
SELECT * FROM (SELECT session_id, tool, count(*) AS n,
    row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, tool) AS rank
  FROM lines WHERE tool IS NOT NULL GROUP BY session_id, tool) WHERE rank <= 6"""),
    "corrections": sessions(f"""
SELECT session_id, place, {cut(200)} AS correction FROM lines WHERE human AND regexp_matches(text, '{CORRECTION}')"""),
    "first_messages": sessions(f"""
SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place) AS rank, {cut(300)} AS message
  FROM lines WHERE human) WHERE rank <= 8"""),
    "session_index": sessions("""
SELECT s.session_id, n_events, coalesce(cwd, '') AS cwd, coalesce(end_reason, '') AS end_reason
FROM stats s LEFT JOIN (SELECT user_id::VARCHAR AS session_id, arg_max(props, event_id) AS cwd,
  arg_max(event_type, event_id) AS end_reason FROM events GROUP BY 1) i ON s.session_id = i.session_id"""),
    "salience": sessions("""
SELECT session_id AS id, salience, CASE WHEN judged THEN 'build' ELSE '' END AS session_class,
       CASE WHEN judged THEN 'ok' ELSE 'pending' END AS status, n_tool_errors AS errors,
       CASE WHEN judged THEN 'a note' ELSE '' END AS notes, n_mutations AS mutations FROM scored"""),
    "escalation": sessions("""
, signals AS (SELECT DISTINCT user_id::VARCHAR AS session_id, event_type || ':' || props AS signal FROM events),
counted AS (SELECT signal, count(*) AS n FROM signals GROUP BY signal),
recurring AS (SELECT session_id, max(n) AS recurrence FROM signals JOIN counted USING (signal) GROUP BY session_id)
SELECT s.session_id AS id, salience, coalesce(recurrence, 0) AS recurrence
FROM scored s LEFT JOIN recurring r ON s.session_id = r.session_id
WHERE salience >= 0.5 OR coalesce(recurrence, 0) >= 3"""),
    "pending_sessions": sessions("SELECT session_id, n_events FROM stats WHERE n_tool_errors % 2 = 1"),
    "triage_summary": sessions("""
SELECT count(*) FILTER (judged) AS ok, count(*) FILTER (NOT judged) AS pending,
       (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'system') AS already_done FROM scored"""),
    "recurrence": """
SELECT event_type || ':' || props AS signal, count(DISTINCT user_id) AS n_sessions FROM events
GROUP BY 1 HAVING count(DISTINCT user_id) >= 3""",
}

# --- the sweep over lines at even places, then the others -----------------------------------------------------------

# salience of the lines of the first sweep, and of all
def swept(query: str) -> str:
    return f"""WITH {TRANSCRIPT.replace("scored AS (", "scored_all AS (")},
per_half AS (
  SELECT session_id, half, count(*) FILTER (place % 2 <= half) AS n_events, count(*) FILTER (human) AS n_human,
         count(tool) AS n_tools, count(*) FILTER (agent) AS n_agent, count(*) FILTER (failed) AS n_failed,
         count(*) FILTER (tool IN ('Edit', 'Write')) AS n_mutations,
         count(*) FILTER (human AND regexp_matches(text, '{CORRECTION}')) AS n_corrections
  FROM lines, (SELECT unnest([0, 1]) AS half) WHERE place % 2 <= half GROUP BY session_id, half),
known AS (
  SELECT session_id, half, n_events, n_human, n_tools, least(1.0, least(0.5, 0.25 * n_corrections) + least(0.3, 0.08 * n_failed)
    + least(0.15, 0.01 * n_mutations) + CASE WHEN n_human = 0 AND n_agent > 20 THEN 0.1 ELSE 0.0 END) AS points
  FROM per_half
  UNION ALL
  SELECT 'broken-' || conv_id, 1, 0, 0, 0, 0.0 FROM conversations WHERE turn = 0),
changed AS (
  SELECT k.*, round(points, 2)::DOUBLE AS salience, round(points, 2) >= 0.5 AS escalated,
         k.session_id IN (SELECT conv_id::VARCHAR FROM conversations WHERE role = 'system') AS judged,
         CASE WHEN n_events = 0 THEN 'no readable line' ELSE '' END AS error
  FROM known k
  WHERE k.half = 0 OR k.n_events = 0 OR k.session_id IN (SELECT session_id FROM lines WHERE place % 2 = 1)
    OR k.session_id IN (SELECT conv_id::VARCHAR FROM conversations WHERE turn = 1)),
journal AS (
  SELECT * FROM (
    SELECT *, CASE WHEN judged THEN 'ok' ELSE 'pending' END AS status FROM changed c
    -- a broken line alone does not reopen a finished session
    WHERE half = 0 OR NOT judged OR n_events > coalesce((SELECT max(n_events) FROM changed d
      WHERE d.session_id = c.session_id AND d.half = 0), -1))),
current AS (SELECT * FROM journal QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY half DESC) = 1),
answered AS (
  SELECT session_id AS id, half, CASE WHEN n IS NULL THEN 'no reply' WHEN n % 5 = 0 THEN 'no reply'
           WHEN n % 5 = 1 THEN 'the reply holds no JSON object' ELSE '' END AS reason, n
  FROM journal LEFT JOIN (SELECT DISTINCT user_id AS n FROM events) u ON session_id = n::VARCHAR WHERE escalated),
findings AS (SELECT a.* FROM answered a JOIN current c ON a.id = c.session_id AND a.half = c.half),
drafts AS (
  SELECT id AS finding_id, half, unnest([{{'type': 'script', 'title': 'fix ' || id, 'body': 'b', 'status': 'pending'}},
    {{'type': 'lesson', 'title': 'learn', 'body': '', 'status': 'written'}}], recursive := true) FROM answered WHERE reason = '')
{query}"""


SWEEPS = {
    "stream_sweep": swept("""
SELECT session_id AS id, status, salience, n_events AS events, n_human AS human, n_tools AS tool_uses, escalated, error, half AS batch
FROM current"""),
    "stream_quarantine": swept("""
SELECT session_id AS id, 'reading' AS stage, error FROM current WHERE error <> ''
UNION ALL SELECT id, 'reply', reason FROM findings WHERE reason <> ''"""),
    "stream_findings": swept("""
SELECT id, CASE WHEN reason = '' THEN 'ok' ELSE 'pending' END AS status, CASE WHEN reason = '' THEN 'cause ' || id ELSE '' END AS root_cause,
       CASE WHEN reason = '' THEN round(least(1.0, n % 150 / 100.0), 2)::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
       CASE WHEN reason = '' THEN 2 ELSE 0 END::BIGINT AS n_artifacts FROM findings"""),
    "stream_artifacts": swept("""
SELECT d.finding_id, left(sha256(d.finding_id || '|' || type || '|' || title || '|' || body), 12) AS id, type, title, d.status
FROM drafts d JOIN current c ON d.finding_id = c.session_id AND d.half = c.half"""),
    "stream_summary": swept("""
SELECT count(DISTINCT k.session_id) AS scanned, count(DISTINCT j.session_id) AS processed,
       count(DISTINCT j.session_id) FILTER (j.escalated) AS escalated,
       count(DISTINCT j.session_id) FILTER (j.status = 'pending') AS pending,
       any_value((SELECT count(*) FROM drafts d WHERE d.half = k.half)) AS artifacts,
       count(DISTINCT j.session_id) FILTER (j.error <> '') + any_value((SELECT count(*) FROM answered a
         WHERE a.half = k.half AND reason <> '')) AS failed, k.half AS batch
FROM changed k LEFT JOIN journal j ON j.session_id = k.session_id AND j.half = k.half GROUP BY k.half"""),
}

# --- conversations --------------------------------------------------------------------------------------------------

CONTRACT = f"""
SELECT conv_id, n_messages, n_assistant, faulty_turn, CASE
    WHEN faulty_turn IS NOT NULL THEN fault
    WHEN n_messages < 2 THEN 'fewer than two messages' WHEN n_assistant = 0 THEN 'no assistant message'
    WHEN last_role <> 'assistant' THEN 'does not end with an assistant message' END AS first_error
FROM (
  SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_assistant,
         min(turn) FILTER (fault IS NOT NULL) AS faulty_turn, arg_min(fault, turn) FILTER (fault IS NOT NULL) AS fault,
         arg_max(role, turn) AS last_role
  FROM (SELECT *, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'invalid role'
          WHEN {STRIPPED} = '' THEN 'empty content' END AS fault FROM %s) GROUP BY conv_id)"""
TRIMMED = """
trimmed AS (
  SELECT c.* FROM conversations c JOIN (
    SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id) e
  ON c.conv_id = e.conv_id AND c.turn <= e.last)"""
VALID = f"""
WITH {TRIMMED},
valid AS (SELECT conv_id FROM ({CONTRACT % 'trimmed'}) WHERE first_error IS NULL),
hashed AS (
  SELECT conv_id, sha256({marked('position')} || {marked('role')} || {marked('body')}) AS h
  FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, {STRIPPED} AS body FROM trimmed)),
prints AS (
  SELECT conv_id, count(*) AS n_messages, count(*) || '-' || {SLICES} AS fingerprint
  FROM hashed WHERE conv_id IN (SELECT conv_id FROM valid) GROUP BY conv_id)"""


def split(value: str) -> str:
    return (f"CASE WHEN ('0x' || substr(sha256('{fixed.SPLIT_SEED}:' || {value}), 1, 8))::BIGINT % 1000000 < 50000 "
            "THEN 'eval' ELSE 'train' END")


ENTRIES = f"""
WITH entries AS (
  SELECT doc_id AS entry, source, sha256({STRIPPED}) AS fingerprint, {STRIPPED} = '' AS bad FROM documents),
statuses AS (
  SELECT *, CASE WHEN bad THEN 'bad' WHEN entry = min(entry) OVER (PARTITION BY fingerprint, bad) THEN 'written'
    ELSE 'duplicate' END AS status, {split('fingerprint')} AS split FROM entries)"""

CONVERSATIONS = {
    "conversation_contract": CONTRACT % "conversations",
    "conversation_errors": f"""
SELECT * FROM ({CONTRACT % 'conversations'}) WHERE first_error IS NOT NULL""",
    "merge_turns": """
WITH two_sided AS (
  SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 'user' ELSE role END AS role FROM conversations),
marked AS (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS starts
  FROM two_sided),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM marked)
SELECT conv_id, min(turn) AS turn, min(role) AS role, count(*) AS n_turns, length(string_agg(text, chr(10))) AS n_chars,
       """ + digest("turn", "text") + """ AS pieces, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest
FROM islands GROUP BY conv_id, island""",
    "residual_secrets": """
SELECT conv_id FROM conversations WHERE conv_id % 6 = 0 AND turn < 2 GROUP BY conv_id HAVING count(*) = 2""",
    "trim_turns": f"WITH {TRIMMED} SELECT conv_id, turn, role FROM trimmed",
    "fingerprint_dedup": f"""{VALID}
SELECT conv_id, n_messages, fingerprint,
       CASE WHEN conv_id = min(conv_id) OVER (PARTITION BY fingerprint) THEN 'written' ELSE 'duplicate' END AS status
FROM prints""",
    "conversation_split": f"{VALID} SELECT conv_id, {split('fingerprint')} AS split FROM prints",
    "contamination": f"""{ENTRIES},
sides AS (SELECT *, {split('entry')} AS side FROM entries),
flagged AS (
  SELECT *, fingerprint IN (SELECT fingerprint FROM sides WHERE side = 'eval') AS leaked FROM sides WHERE side = 'train')
SELECT source, count(*) AS n_kept, (SELECT count(*) FROM flagged WHERE leaked) AS n_removed
FROM flagged WHERE NOT leaked GROUP BY source""",
    "dataset_card": f"""{ENTRIES}
SELECT source, count(*) AS n_rows, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'eval') AS n_eval,
       round(count(*) / (SELECT count(*) FROM statuses WHERE status = 'written'), 4) AS share
FROM statuses WHERE status = 'written' GROUP BY source""",
    "source_stats": f"{ENTRIES} SELECT source, status, count(*) AS n FROM statuses GROUP BY source, status",
    "answer_scoring": """
SELECT count(*) FILTER (CASE quality WHEN 1 THEN contains(lower(text), 'the') AND contains(lower(text), 'in')
         WHEN 0 THEN contains(text, '.') AND contains(lower(text), lang) ELSE true END) AS passed, count(*) AS total
FROM documents LEFT JOIN labels USING (doc_id)""",
}

# --- audits ---------------------------------------------------------------------------------------------------------

AUDITS = {
    "sql_audit": """
SELECT decision, reason, count(*) AS n FROM (
  SELECT CASE WHEN left(o_orderpriority, 1) IN ('1', '5') THEN 'allow' ELSE 'deny' END AS decision,
         CASE left(o_orderpriority, 1) WHEN '2' THEN 'write keyword' WHEN '3' THEN 'stacked statements'
           WHEN '4' THEN 'not a read' ELSE 'select-only' END AS reason FROM orders)
GROUP BY decision, reason""",
    "egress_audit": """
SELECT host, decision, reason, count(*) AS n FROM (
  SELECT host, CASE WHEN page_id % 3 <> 1 AND listed THEN 'allow' ELSE 'deny' END AS decision,
         CASE WHEN page_id % 3 = 1 THEN 'write verb POST' WHEN NOT listed THEN 'host not listed'
           WHEN page_id % 3 = 0 THEN 'GET' ELSE 'HEAD' END AS reason
  FROM (SELECT page_id, host, host IN ('shop.example.com', 'm.ththth.example.net') AS listed
        FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM pages)))
GROUP BY host, decision, reason""",
    "tool_audit": """
SELECT tool, decision, reason, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'http' WHEN 'view' THEN 'warehouse_query' WHEN 'purchase' THEN 'Edit'
           WHEN 'signup' THEN 'list_events' ELSE 'probe' END AS tool,
         CASE event_type WHEN 'click' THEN CASE WHEN value < 25 THEN 'allow' ELSE 'deny' END
           WHEN 'view' THEN CASE WHEN value < 50 THEN 'allow' ELSE 'deny' END
           WHEN 'signup' THEN 'allow' ELSE 'deny' END AS decision,
         CASE event_type
           WHEN 'click' THEN CASE WHEN value < 25 THEN 'GET' WHEN value < 50 THEN 'host not listed'
             ELSE 'write verb DELETE' END
           WHEN 'view' THEN CASE WHEN value < 50 THEN 'select-only' ELSE 'not a read' END
           WHEN 'purchase' THEN 'tool can change things' WHEN 'signup' THEN 'read tool' ELSE 'unknown tool' END AS reason
  FROM events)
GROUP BY tool, decision, reason""",
}

READERS["dataset_collect"] = MESSAGES.format(body=STRIPPED)

PERSONAL = "('payment-card', 'phone')"
PLANTED_TEXTS = "SELECT doc_id, kind, 'seen: ' || found || ' - noted' AS text FROM (SELECT doc_id, CASE doc_id % {0} {1} END AS kind, CASE doc_id % {0} {2} END AS found FROM documents)".format(
    len(PLANTED), " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(PLANTED)),
    " ".join(f"WHEN {i} THEN {found.format(LETTERS)}" for i, (found, _) in enumerate(PLANTED.values())))
LEAKING = " OR ".join(f"contains(text, '{part}')" for part in LEAKS)
LOADING |= {
    "planted_counts": f"SELECT kind, count(*) AS n_hits, count(*) AS n_documents FROM ({PLANTED_TEXTS}) GROUP BY kind",
    "planted_audit": f"""
SELECT count(*) AS n_documents, count(*) FILTER (kind NOT IN {PERSONAL}) AS held_secrets, 0::BIGINT AS leaks FROM ({PLANTED_TEXTS})""",
    "planted_tripwire": f"""
SELECT kind, count(*) FILTER (kind NOT IN {PERSONAL}) AS blocked_raw, 0::BIGINT AS blocked_redacted FROM ({PLANTED_TEXTS}) GROUP BY kind""",
    "planted_leaks": f"""
SELECT 'text' AS column_name, count(*) AS n_rows, count(*) FILTER ({LEAKING}) AS n_leaks FROM ({PLANTED_TEXTS})
UNION ALL SELECT 'clean_text', count(*), 0 FROM documents""",
}
READERS |= {
    "dataset_limits": f"""
WITH taken AS (
  SELECT * FROM (
    SELECT doc_id, doc_id % 2 AS side, {STRIPPED} AS body, lang, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) AS nth FROM documents)
  WHERE nth <= CASE side WHEN 0 THEN 60 ELSE 90 END),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'bad'
    WHEN row_number() OVER (PARTITION BY body, lang ORDER BY side, doc_id) > 1 THEN 'duplicate' ELSE 'written' END AS status FROM taken),
counted AS (SELECT *, count(*) FILTER (status = 'written') OVER (ORDER BY side, doc_id) AS n_written FROM judged)
SELECT CASE side WHEN 0 THEN 'even' ELSE 'odd' END AS source, status, count(*) AS n FROM counted
WHERE n_written < 120 OR (n_written = 120 AND status = 'written') GROUP BY 1, 2""",
    "dataset_files": f"""
SELECT source, count(*) AS n, sum(length(body))::BIGINT AS n_chars, count(*) AS n_in_splits FROM (
  SELECT body, lang, CASE min(doc_id % 2) WHEN 0 THEN 'even' ELSE 'odd' END AS source
  FROM (SELECT *, {STRIPPED} AS body FROM documents) WHERE body <> '' GROUP BY body, lang) GROUP BY source""",
    "stored_log": f"""
SELECT row_number() OVER (ORDER BY o_orderkey) AS rank, e.case_id, e.activity, e.us
FROM orders JOIN ({LOADING["event_normalise"]}) e ON e.ingest_seq = o_orderkey""",
    "audit_sink": AUDITS["sql_audit"],
    "reply_parsing": """
SELECT n::VARCHAR AS id, CASE WHEN n % 5 = 1 THEN 'pending' ELSE 'ok' END AS status,
       CASE WHEN n % 5 = 1 THEN 'the reply holds no JSON object' ELSE '' END AS reason, CASE WHEN n % 5 = 1 THEN '' ELSE 'cause ' || n END AS root_cause,
       CASE WHEN n % 5 = 1 THEN 0.0 ELSE round(least(1.0, n % 150 / 100.0), 2) END::DOUBLE AS confidence, CASE WHEN n % 5 = 1 THEN 0 ELSE 2 END::BIGINT AS n_artifacts
FROM (SELECT DISTINCT user_id AS n FROM events) WHERE n % 5 <> 0""",
}
CONVERSATIONS["minimum_turns"] = """
WITH marked AS (
  SELECT conv_id, turn, CASE role WHEN 'system' THEN 'user' ELSE role END AS role FROM conversations),
starts AS (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS starts FROM marked)
SELECT conv_id, sum(starts)::BIGINT AS n_messages, arg_max(role, turn) AS last_role FROM starts GROUP BY conv_id HAVING sum(starts) >= 4"""

REGISTER["citation_filter"] = REGISTER["citation_gate"]
REGISTER["fact_rows"] = f"""
SELECT row_number() OVER (ORDER BY fqn) AS rank, fqn AS evidence_fqn, name, value, evidence_json AS detail FROM ({REGISTER["metric_upsert"]})"""

CONVERSATIONS["convert_transcripts"] = f"""
WITH said AS (
  SELECT conv_id, turn, role, {STRIPPED} AS text
  FROM (SELECT conv_id, turn, role, regexp_replace(text, '[^\\p{{L}}\\s]', '', 'g') AS text FROM conversations) WHERE {STRIPPED} <> ''),
turns AS (
  SELECT * FROM said WHERE role IN ('user', 'assistant')
  UNION ALL SELECT DISTINCT conv_id, 1000000, 'assistant', 'Looking.' || chr(10) || '→ Read({{"note": "all, of it", "at": [1, 2]}})' FROM conversations),
marked AS (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS starts FROM turns),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM marked),
runs AS (SELECT conv_id, island, string_agg(text, chr(10) ORDER BY turn) AS text FROM islands GROUP BY conv_id, island)
SELECT conv_id::VARCHAR AS conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, arg_max(text, island) AS last,
       'own' AS source, 'redacted trajectory from ' || conv_id AS notes
FROM runs GROUP BY conv_id HAVING count(*) >= 4"""

ORACLE: dict[str, str] = {
    **READERS, **{name: jobs(sql) for name, sql in MINING.items()}, **WEB, **FINDINGS, **REGISTER, **LOADING, **SESSIONS,
    **SWEEPS, **CONVERSATIONS, **AUDITS,
}

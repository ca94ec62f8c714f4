"""Findings and artifacts from the replies of an analysis made elsewhere, each reply judged on its own.

A reply that cannot be used makes its session's finding pending with a reason; it never stops the other sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.messages import items
from casetrail.functions.rows import computed
from casetrail.functions.text import clean_artifacts, embedded_json, proposal_id, proposal_route, strip

NO_REPLY = "no reply"
NOT_AN_OBJECT = "the reply holds no JSON object"
ROOT_CAUSE_CHARS = 1000


def _spelled(value: Column, path: str) -> Column:
    """A member as text; objects and lists in JSON, nothing for a missing one."""
    return F.try_variant_get(value, path, "string")


def _confidence(value: Column) -> Column:
    number = F.try_variant_get(value, "$.confidence", "double")
    usable = number.isNotNull() & ~F.isnan(number)
    return F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))).otherwise(F.lit(0.0))


def read_replies(replies: DataFrame) -> DataFrame:
    """Findings ``id, status, reason, root_cause, confidence, artifacts`` from ``session_id, reply``.

    The JSON object may stand in a fenced block or between other words. A null reply, and one without such an object, is pending
    with a ``reason``. Artifacts are tidied, entries that are not objects or of an unknown type are left out.
    """
    found = computed(replies.select("session_id", "reply"), ["session_id", "reply"],
                     F.struct(F.try_parse_json(embedded_json(F.col("reply"), greedy=True)).alias("answer")))
    kind = F.coalesce(F.schema_of_variant("answer"), F.lit(""))
    answer = F.when(kind.startswith("OBJECT"), F.col("answer"))
    found = computed(found, ["session_id", "reply"], F.struct(answer.alias("answer")))
    # the cap counts every entry, also those that are not objects and so have no type
    slots = F.transform(items(F.try_variant_get("answer", "$.artifacts", "variant")), lambda a: F.struct(
        *[_spelled(a, f"$.{name}").alias(name) for name in ("type", "title", "rationale", "body")]))
    none = F.expr("array()").cast("array<struct<type:string,title:string,rationale:string,body:string>>")
    usable = F.col("answer").isNotNull()
    reason = F.when(F.col("reply").isNull(), NO_REPLY).when(~usable, NOT_AN_OBJECT).otherwise("")
    cause = F.substring(strip(F.coalesce(_spelled(F.col("answer"), "$.root_cause"), F.lit(""))), 1, ROOT_CAUSE_CHARS)
    return found.select(
        F.col("session_id").alias("id"), F.when(usable, "ok").otherwise("pending").alias("status"), reason.alias("reason"),
        cause.alias("root_cause"), _confidence(F.col("answer")).alias("confidence"),
        F.coalesce(clean_artifacts(slots), none).alias("artifacts"))


def artifact_rows(findings: DataFrame) -> DataFrame:
    """One row per artifact: ``finding_id``, ``id`` (by content), ``type, title, rationale, body``, ``route`` (``queue`` for what a person
    has to approve) and ``status``."""
    each = findings.select(F.col("id").alias("finding_id"), F.inline("artifacts"))
    route = proposal_route(F.col("type"))
    return each.select(
        "finding_id", proposal_id(F.col("finding_id"), F.col("type"), F.col("title"), F.col("body")).alias("id"), "type", "title",
        "rationale", "body", route.alias("route"), F.when(route == "queue", "pending").otherwise("written").alias("status"))

"""Read-only audits of statement, request and tool-call logs, as rows for the audit table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import guards


def _judged(log: DataFrame, verdict: Column) -> DataFrame:
    judged = log.withColumn("_verdict", verdict)
    return judged.select(*log.columns, F.col("_verdict.decision").alias("decision"),
                         F.col("_verdict.reason").alias("reason"))


def sql_audit(statements: DataFrame, column: str = "sql") -> DataFrame:
    return _judged(statements, guards.classify_sql(F.col(column)))


def egress_audit(requests: DataFrame, allowed_hosts: Iterable[str]) -> DataFrame:
    """``requests`` has ``method`` and ``url``; ``host`` is added."""
    hosted = requests.withColumn("host", guards.host_of(F.col("url")))
    return _judged(hosted, guards.classify_egress(F.col("host"), F.col("method"), allowed_hosts))


def tool_audit(calls: DataFrame, allowed_hosts: Iterable[str]) -> DataFrame:
    """``calls`` has ``tool`` and ``args`` (``map<string,string>``)."""
    return _judged(calls, guards.classify_tool_call(F.col("tool"), F.col("args"), allowed_hosts))


def audit_rows(judged: DataFrame, ts: Column, actor: Column, action: Column, target: Column, verb: Column) -> DataFrame:
    """Judged rows in the shape of the audit table."""
    return judged.select(ts.alias("ts"), actor.alias("actor"), action.alias("action"), target.alias("target"),
                         verb.alias("verb"), "decision", "reason")

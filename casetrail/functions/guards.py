"""Column functions that classify statements, requests and tool calls as read-only or not."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions.text import strip

ALLOW, DENY = "allow", "deny"


def _verdict(decision: str, reason: Column) -> Column:
    return F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))


def classify_sql(sql: Column) -> Column:
    """``struct<decision, reason>``: allowed is one statement that starts as a read and holds no write word."""
    statement = strip(F.coalesce(sql, F.lit("")))
    body = strip(F.regexp_replace(statement, ";$", ""))
    return (
        F.when(F.contains(body, F.lit(";")), _verdict(DENY, F.lit("stacked statements")))
        .when(~body.rlike("(?i)" + fixed.READ_START_PATTERN), _verdict(DENY, F.lit("not a read")))
        .when(body.rlike("(?i)" + fixed.WRITE_WORD_PATTERN), _verdict(DENY, F.lit("write keyword")))
        .otherwise(_verdict(ALLOW, F.lit("select-only"))))


def host_of(url: Column) -> Column:
    """Host name of a URL in lower case, empty when there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def classify_egress(host: Column, method: Column, allowed_hosts: Iterable[str]) -> Column:
    """``struct<decision, reason>``: a read verb to a listed host."""
    verb = F.upper(F.coalesce(method, F.lit("")))
    return (
        F.when(~verb.isin(fixed.READ_VERBS), _verdict(DENY, F.concat(F.lit("write verb "), verb)))
        .when(~F.coalesce(host, F.lit("")).isin(list(allowed_hosts)), _verdict(DENY, F.lit("host not listed")))
        .otherwise(_verdict(ALLOW, verb)))


def classify_tool_call(tool: Column, args: Column, allowed_hosts: Iterable[str]) -> Column:
    """``struct<decision, reason>`` for a tool name and its arguments (``map<string,string>``). Unknown tools are
    denied; SQL and HTTP tools are judged by what they are asked to do."""
    name = F.lower(F.coalesce(tool, F.lit("")))

    def arg(key: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at(args, F.lit(key)), default)

    sql = arg("sql", arg("query", F.lit("")))
    stated = arg("host", F.lit(""))
    host = F.when(stated != "", stated).otherwise(host_of(arg("url", F.lit(""))))
    return (
        F.when(name.isin(fixed.MUTATING_TOOLS), _verdict(DENY, F.lit("tool can change things")))
        .when(F.contains(name, F.lit("sql")) | name.isin(fixed.SQL_TOOLS), classify_sql(sql))
        .when(name.isin(fixed.HTTP_TOOLS), classify_egress(host, arg("method", F.lit("GET")), allowed_hosts))
        .when(name.isin(fixed.READ_TOOLS), _verdict(ALLOW, F.lit("read tool")))
        .otherwise(_verdict(DENY, F.lit("unknown tool"))))

"""Operator exports (CSV, JSON) as event logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.functions.parse import canonical_activity, parse_timestamp
from casetrail.functions.scrub import scrub
from casetrail.functions.text import strip
from casetrail.operators.mining import EventLog
from casetrail.session import spread
from casetrail.sources import quoted
from casetrail.sources.files import BLOCK, FILE, ORIGIN, file_offsets, with_ingest_seq


@dataclass(frozen=True)
class ColumnMap:
    """Which source column holds what. Case, activity and time are required."""

    case_id: str
    activity: str
    ts: str
    resource: str = ""
    entity_fqn: str = ""
    source_system: str = "fsm"

    def named(self) -> dict[str, str]:
        every = {"case_id": self.case_id, "activity": self.activity, "ts": self.ts, "resource": self.resource,
                 "entity_fqn": self.entity_fqn}
        return {field: column for field, column in every.items() if column}


XES = ColumnMap("case:concept:name", "concept:name", "time:timestamp", "org:resource", source_system="real")


def read_csv(spark: SparkSession, path: str, columns: ColumnMap) -> DataFrame:
    """Raw text cells ``case_id, activity, ts, resource, entity_fqn, ingest_seq`` of CSV exports with a header.

    Files are read in blocks, also where quoted cells span lines (see :mod:`casetrail.sources.quoted`).
    """
    read = quoted.read_cells(spark, path)
    present = set(read.schema["cells"].dataType.names)
    cells = [F.coalesce(F.col("cells")[column], F.lit("")).alias(field) if column in present else F.lit("").alias(field)
             for field, column in columns.named().items()]
    rows = read.select(*cells, FILE, BLOCK, quoted.PLACE)
    return _complete(with_ingest_seq(rows, F.col(quoted.PLACE), file_offsets(spark, path)))


def read_json(spark: SparkSession, path: str, columns: ColumnMap) -> DataFrame:
    """The same cells from JSON documents: a list of rows, or an object with a ``rows`` list.

    A document is one value, which a task reads whole: exports of any size are many documents, or CSV. Anything but a
    list of rows is an error, list entries that are not objects are skipped.
    """
    read = spark.read.option("wholetext", True).text(path)
    text = F.regexp_replace("value", "^﻿", "")
    listed = F.from_json(text, "array<variant>")
    inside = F.from_json(text, "struct<rows:array<variant>>").getField("rows")
    is_list = F.ltrim(text).startswith("[")
    rows = F.coalesce(F.when(is_list, listed), F.when(~is_list, inside),
                      F.raise_error(F.lit("a JSON export must be a list of rows or an object with a 'rows' list")))
    entries = read.select(F.posexplode(rows).alias("_at", "_row"), *[F.expr(e) for e in ORIGIN])
    objects = entries.where(F.schema_of_variant("_row").startswith("OBJECT"))
    cells = [F.coalesce(F.try_variant_get("_row", f"$[{_quoted(column)}]", "string"), F.lit("")).alias(field)
             for field, column in columns.named().items()]
    found = objects.select(*cells, "_at", FILE, BLOCK)
    return _complete(with_ingest_seq(found, F.col("_at"), file_offsets(spark, path))).drop("_at")


def _quoted(name: str) -> str:
    return '"' + name + '"' if "'" in name else "'" + name + "'"


def read_export(spark: SparkSession, path: str, columns: ColumnMap) -> DataFrame:
    return (read_json if path.lower().endswith(".json") else read_csv)(spark, path, columns)


def _complete(rows: DataFrame) -> DataFrame:
    for optional in ("resource", "entity_fqn"):
        if optional not in rows.columns:
            rows = rows.withColumn(optional, F.lit(""))
    return rows.drop(BLOCK, "_place_in")


def parsed(raw: DataFrame) -> DataFrame:
    """Rows with a case, an activity and a time, the time parsed (``ts``, NULL where it is malformed)."""
    named = raw.withColumns({"case_id": strip(F.col("case_id")), "activity": strip(F.col("activity"))})
    return named.where("case_id <> '' and activity <> '' and ts <> ''").withColumns({
        "raw_ts": F.col("ts"), "ts": parse_timestamp(F.col("ts"))})


def normalise_events(raw: DataFrame, source_system: str, normalise: Callable[[Column], Column] = canonical_activity,
                     case_key: str = "scrubbed", salt: str = "") -> DataFrame:
    """Canonical, scrubbed events from raw cells. Rows whose time is malformed stop the load.

    Scrubbing case ids can make long job numbers indistinguishable; ``case_key='hash'`` keeps the cases apart by a
    salted hash that does not reveal the number.
    """
    rows = parsed(spread(raw))
    # filters may be evaluated together with this, so rows that are skipped must not raise here either
    event = (F.col("case_id") != "") & (F.col("activity") != "") & (F.col("raw_ts") != "")
    malformed = F.raise_error(F.concat(F.lit("malformed timestamp: "), "raw_ts")).cast("timestamp")
    checked = F.coalesce("ts", F.when(event, malformed))
    return _events(rows.withColumn("ts", checked), source_system, normalise, case_key, salt)


def quarantined_events(raw: DataFrame, source_system: str, normalise: Callable[[Column], Column] = canonical_activity,
                       case_key: str = "scrubbed", salt: str = "") -> tuple[DataFrame, DataFrame]:
    """As :func:`normalise_events`, but malformed times go to a second table ``source_path, raw, reason``."""
    rows = parsed(spread(raw))
    path = F.col(FILE) if FILE in raw.columns else F.lit("")
    bad = rows.where("ts is null").select(
        path.alias("source_path"), scrub(F.to_json(F.struct("case_id", "activity", "raw_ts"))).alias("raw"),
        F.lit("malformed timestamp").alias("reason"))
    return _events(rows.where("ts is not null"), source_system, normalise, case_key, salt), bad


def _events(rows: DataFrame, source_system: str, normalise: Callable[[Column], Column], case_key: str,
            salt: str) -> DataFrame:
    if case_key == "hash":
        case = F.sha2(F.concat(F.lit(salt), "case_id"), 256)
    else:
        case = scrub(F.col("case_id"))
    clean = rows.withColumns({
        "case_id": case, "activity": scrub(normalise(F.col("activity"))), "resource": scrub(F.col("resource")),
        "_fqn": scrub(strip(F.col("entity_fqn")))})
    default = F.concat_ws(".", F.lit(source_system), F.lit("job"), "case_id")
    return clean.select(
        "ingest_seq", "case_id", "activity", "ts", "resource", F.lit(source_system).alias("source_system"),
        F.when(F.col("entity_fqn") != "", F.col("_fqn")).otherwise(default).alias("entity_fqn"))


def load_export(spark: SparkSession, path: str, columns: ColumnMap, table_path: str,
                normalise: Callable[[Column], Column] = canonical_activity, **options) -> EventLog:
    """Read, normalise and store an export; the stored table, with its ``ingest_seq``, is what is mined."""
    events = normalise_events(read_export(spark, path, columns), columns.source_system, normalise, **options)
    events.write.mode("overwrite").parquet(table_path)
    return EventLog(spark.read.parquet(table_path))

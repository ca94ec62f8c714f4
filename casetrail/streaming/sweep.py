"""The incremental sweep: transcript lines become triage records, findings and artifacts, each exactly once.

A file stream remembers which files it has seen (also one whose name sorts before earlier ones), its checkpoint takes the place of a
cursor. What is known of a session is keyed state of the stream: counts go on from batch to batch, so a session whose lines come in
several files or batches is one session. A session gets a new record when more of its lines have come, or while it is
pending.

Every batch writes its own folders of the journal (records, findings, artifacts, quarantine, summaries), so a batch that runs again
after a failure replaces what it wrote before. A session that cannot be processed has its error in its record or in the quarantine;
the others go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetrail.functions.text import strip
from casetrail.operators import sessions as S
from casetrail.operators.replies import artifact_rows, read_replies
from casetrail.session import stash
from casetrail.sources.files import ORIGIN
from casetrail.sources.jsonl import parsed_rows, read_index, with_session
from casetrail.streaming.isolation import FAILURES, isolated

RECORDS = """
    id string, ts string, salience double, session_class string,
    signals struct<corrections:bigint, errors:bigint, rule_drift:boolean, notes:string>,
    repo string, status string,
    facts struct<events:bigint, human:bigint, injected:bigint, assistant:bigint, tool_uses:bigint, mutations:bigint,
                 tool_errors:bigint>,
    escalated boolean, error string, run string, batch bigint"""
FINDINGS = """
    id string, status string, reason string, root_cause string, confidence double,
    artifacts array<struct<type:string, title:string, rationale:string, body:string>>, run string, batch bigint"""
ARTIFACTS = """
    finding_id string, id string, type string, title string, rationale string, body string, route string, status string,
    run string, batch bigint"""
QUARANTINE = f"{FAILURES}, run string, batch bigint"
SUMMARIES = """
    scanned bigint, processed bigint, escalated bigint, pending bigint, artifacts bigint, failed bigint, run string, batch bigint"""
UNREADABLE = "no readable line"
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Analysis = Callable[[DataFrame], DataFrame]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no batch has written yet
        return spark.createDataFrame([], schema)


def all_records(spark: SparkSession, journal: str) -> DataFrame:
    """Every record that a batch has written."""
    return _read(spark, f"{journal}/records", RECORDS)


def read_journal(spark: SparkSession, journal: str) -> DataFrame:
    """The current record of every session: the one over most of its lines, of these a finished one, of these the latest."""
    records = all_records(spark, journal)
    latest = F.struct("facts.events", F.col("status") == "ok", "batch", "run")
    whole = F.struct(*records.columns)
    return records.groupBy("id").agg(F.max_by(whole, latest).alias("record")).select("record.*")


def _of_current(spark: SparkSession, journal: str, rows: DataFrame, key: str) -> DataFrame:
    """The rows that belong to the current record of their session."""
    current = read_journal(spark, journal).select(F.col("id").alias(key), "run", "batch")
    return rows.join(current, [key, "run", "batch"], "left_semi").select(*rows.columns)


def read_findings(spark: SparkSession, journal: str) -> DataFrame:
    """The finding of every escalated session, from its current record."""
    return _of_current(spark, journal, _read(spark, f"{journal}/findings", FINDINGS), "id")


def read_artifacts(spark: SparkSession, journal: str) -> DataFrame:
    """The artifacts of the current findings."""
    return _of_current(spark, journal, _read(spark, f"{journal}/artifacts", ARTIFACTS), "finding_id")


def read_quarantine(spark: SparkSession, journal: str) -> DataFrame:
    """What could not be processed in the batch that wrote the session's current record: ``id, stage, error``."""
    return _of_current(spark, journal, _read(spark, f"{journal}/quarantine", QUARANTINE), "id")


def read_summaries(spark: SparkSession, journal: str) -> DataFrame:
    return _read(spark, f"{journal}/summaries", SUMMARIES)


def _unfinished(seen: DataFrame, records: DataFrame) -> DataFrame:
    """Sessions without a finished record over as many lines as are known now."""
    done = records.where("status = 'ok'").groupBy(F.col("id").alias(S.SESSION)).agg(F.max("facts.events").alias("_done"))
    return seen.join(done, S.SESSION, "left").where("_done is null or n_events > _done").drop("_done")


def journal_batch(stats: DataFrame, journal: str, batch: int, run: str = "alone", index: DataFrame | None = None,
                  verdicts: DataFrame | None = None, signals: DataFrame | None = None,
                  analyse: Analysis | DataFrame | None = None) -> None:
    """Journal the sessions of ``stats`` (counts per session so far, stored) as batch ``batch`` of ``run``.

    ``analyse`` gives a ``reply`` for sessions worth a closer look: a table ``session_id, reply``, or a function from the records of those
    sessions to such a table. A function may fail for some sessions: those are found and put in quarantine.
    """
    spark = stats.sparkSession
    here = f"run={run}/batch={batch}"
    seen = S.with_index(stats, index) if index is not None else stats
    before = all_records(spark, journal).where(~((F.col("run") == run) & (F.col("batch") == batch)))
    records = S.triage_records(_unfinished(seen, before), verdicts)
    if signals is None:
        records = records.withColumn("recurrence", F.lit(0).cast("long"))
    else:
        records = S.with_recurrence(records, signals)
    error = F.when(F.col("facts.events") == 0, UNREADABLE).otherwise("")
    records = records.select("*", S.is_escalated().alias("escalated"), error.alias("error")).drop("recurrence")
    records.write.mode("overwrite").parquet(f"{journal}/records/{here}")
    written = spark.read.parquet(f"{journal}/records/{here}")

    escalated = written.where("escalated")
    failures = spark.createDataFrame([], FAILURES)
    replies = None
    if isinstance(analyse, DataFrame):
        replies = escalated.select(F.col("id").alias(S.SESSION)).join(analyse.select(S.SESSION, "reply"), S.SESSION, "left")
    elif analyse is not None:
        replies, failures = isolated(escalated, "id", analyse, f"{journal}/replies/{here}", "analysis")
        if replies is None:
            replies = spark.createDataFrame([], "session_id string, reply string")
        missing = escalated.select(F.col("id").alias(S.SESSION)).join(replies.select(S.SESSION), S.SESSION, "left_anti")
        replies = replies.select(S.SESSION, "reply").unionByName(missing.withColumn("reply", F.lit(None).cast("string")))
    found = read_replies(replies if replies is not None else spark.createDataFrame([], "session_id string, reply string"))
    found.write.mode("overwrite").parquet(f"{journal}/findings/{here}")
    found = spark.read.parquet(f"{journal}/findings/{here}")
    artifact_rows(found).write.mode("overwrite").parquet(f"{journal}/artifacts/{here}")

    unread = written.where("error <> ''").select("id", F.lit("reading").alias("stage"), "error")
    unusable = found.where("status = 'pending'").select("id", F.lit("reply").alias("stage"), F.col("reason").alias("error"))
    # the failures are few, see isolated; the sessions may be many, so no task writes them all
    unusable = unusable.join(F.broadcast(failures.select("id")), "id", "left_anti")
    sink = f"{journal}/quarantine/{here}"
    unread.unionByName(unusable).unionByName(failures).write.mode("overwrite").parquet(sink)

    scanned = stats.agg(F.count(F.lit(1))).scalar()
    n_artifacts = spark.read.parquet(f"{journal}/artifacts/{here}").agg(F.count(F.lit(1))).scalar()
    n_failed = spark.read.parquet(sink).agg(F.countDistinct("id")).scalar()
    summary = written.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("escalated").alias("escalated"),
        F.count_if(F.col("status") == "pending").alias("pending"))
    summary.select(scanned.alias("scanned"), "processed", "escalated", "pending", n_artifacts.alias("artifacts"),
                   n_failed.alias("failed")).write.mode("overwrite").parquet(f"{journal}/summaries/{here}")


def said(lines: DataFrame) -> DataFrame:
    """Transcript rows ``session_id, place, row`` of a stream's lines. The place does not matter for counts."""
    value = F.col("value" if "value" in lines.columns else "line")
    named = with_session(lines).select(S.SESSION, F.lit(0).alias("place"), strip(value).alias("line"))
    return parsed_rows(named.where("line <> ''"))


def sweep_batch(lines: DataFrame, journal: str, batch: int, **options) -> None:
    """Journal the sessions of some lines (``value`` or ``line``, with their file or a ``session_id``), without a stream."""
    journal_batch(stash(S.session_stats(said(lines))), journal, batch, **options)


def transcript_stream(spark: SparkSession, transcripts: str, names: str = "*.jsonl",
                      schema: str = "value string") -> DataFrame:
    """Lines of the transcript files in a folder as a stream. Old files count as much as new ones."""
    return (spark.readStream.format("text").schema(schema).option("pathGlobFilter", names)
            .option("maxFileAge", "3650d").load(transcripts).select("*", *[F.expr(e) for e in ORIGIN]))


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of lines that carry their session, ``session_id, value``: Parquet files of many sessions each."""
    return spark.readStream.schema("session_id string, value string").option("maxFileAge", "3650d").parquet(folder)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State of streams started here lives in RocksDB on the executors' disks, not in their memory."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start(lines: DataFrame, journal: str, checkpoint: str, index_path: str | None = None,
          verdicts: DataFrame | None = None, every: str | None = None, signals: DataFrame | None = None,
          analyse: Analysis | DataFrame | None = None) -> StreamingQuery:
    """Process the new lines: once, or again and again with ``every`` (such as '60 seconds').

    ``verdicts``, ``signals`` and ``analyse`` are judgements made elsewhere, of any session (see :mod:`casetrail.operators.sessions` and
    :func:`journal_batch`). The journal keeps what different checkpoints wrote apart.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def process(changed: DataFrame, number: int) -> None:
        index = read_index(changed.sparkSession, index_path) if index_path else None
        journal_batch(stash(changed), journal, number, run, index, verdicts, signals, analyse)

    with _state_on_disk(lines.sparkSession):
        writer = S.session_stats(said(lines)).writeStream.outputMode("update").foreachBatch(process)
        writer = writer.option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start()


def sweep_once(spark: SparkSession, transcripts: str, journal: str, checkpoint: str, **options) -> DataFrame:
    """One sweep over a folder; returns the journal."""
    start(transcript_stream(spark, transcripts), journal, checkpoint, **options).awaitTermination()
    return read_journal(spark, journal)

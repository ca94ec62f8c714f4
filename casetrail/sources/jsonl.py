"""JSON-lines sources and sinks: datasets, transcripts, the session index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions.rows import computed
from casetrail.functions.text import strip
from casetrail.session import broadcast_if_small, stash
from casetrail.sources.files import BLOCK, FILE, ORIGIN, place_in_file


def read_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Non-blank lines as ``_file, place, line``; ``place`` rises within a file."""
    read = spark.read.option("recursiveFileLookup", recursive).text(path).select("value", *[F.expr(e) for e in ORIGIN])
    return placed_lines(read)


def placed_lines(read: DataFrame) -> DataFrame:
    """As :func:`read_lines`, from rows that carry their origin (also those of a stream's batch)."""
    kept = [c for c in read.columns if c not in ("value", BLOCK)]
    lines = read.select(*kept, place_in_file().alias("place"), strip(F.col("value")).alias("line"))
    return lines.where("line <> ''")


def strict_rows(lines: DataFrame) -> DataFrame:
    """Each line as a VARIANT ``row``; a line that is not JSON stops the read and is named by file and place."""
    where = F.concat(F.col(FILE), F.lit(" at "), F.col("place").cast("string"), F.lit(": invalid JSON"))
    # filters may be evaluated together with this, so blank lines are let through here as well
    broken = F.when(F.col("line") != "", F.raise_error(where).cast("variant"))
    checked = F.coalesce(F.try_parse_json("line"), broken)
    return computed(lines, ["*"], F.struct(checked.alias("row")))


def parsed_rows(lines: DataFrame) -> DataFrame:
    """Each line as a VARIANT ``row``, NULL where it is not JSON."""
    return computed(lines, ["*"], F.struct(F.try_parse_json("line").alias("row")))


def tolerant_rows(lines: DataFrame) -> DataFrame:
    """Each line as a VARIANT ``row``; lines that are not JSON are left out."""
    return parsed_rows(lines).where("row is not null")


def with_session(lines: DataFrame) -> DataFrame:
    """Add ``session_id`` and ``date`` from file names like ``<date>-<id>.jsonl``, unless the lines have them."""
    if "session_id" in lines.columns:
        return lines
    name = F.regexp_replace(F.element_at(F.split(FILE, "/"), -1), r"\.jsonl$", "")
    dated = name.rlike(fixed.TRANSCRIPT_NAME_PATTERN)
    return lines.withColumns({
        "date": F.when(dated, F.regexp_extract(name, fixed.TRANSCRIPT_NAME_PATTERN, 1)).otherwise(""),
        "session_id": F.when(dated, F.regexp_extract(name, fixed.TRANSCRIPT_NAME_PATTERN, 2)).otherwise(name)})


def read_transcripts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Transcript lines as ``session_id, date, place, row``; broken lines are left out.

    A file is a session. Files of equal names in different folders have their folder before the name in the
    ``session_id``.
    """
    pattern = "*.jsonl"
    read = (spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path)
            .select("value", *[F.expr(e) for e in ORIGIN]))
    lines = with_session(placed_lines(read))
    return tolerant_rows(_told_apart(lines))


def _told_apart(lines: DataFrame) -> DataFrame:
    """Lines with session ids that no two files share: ids that several files have are put behind the file's folder."""
    files = stash(lines.select(FILE, "session_id").distinct())
    shared = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("_files")).where("_files > 1").drop("_files")
    folder = F.regexp_replace(F.regexp_replace(FILE, "/[^/]*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    long = files.join(shared, "session_id").select(FILE, F.concat(folder, F.lit("/"), "session_id").alias("_long"))
    named = lines.join(broadcast_if_small(long), FILE, "left")
    return named.withColumn("session_id", F.coalesce("_long", "session_id")).drop("_long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The last index line of every session: ``session_id, ts, cwd, reason``."""
    rows = tolerant_rows(read_lines(spark, path))
    fields = {name: F.coalesce(F.try_variant_get("row", f"$.{name}", "string"), F.lit(""))
              for name in ("session_id", "ts", "cwd", "reason")}
    known = rows.select(FILE, "place", *[c.alias(name) for name, c in fields.items()]).where("session_id <> ''")
    return last_entries(known, [FILE, "place"])


def last_entries(index: DataFrame, order: list[str]) -> DataFrame:
    """The entry of every session that is last in ``order``; no two entries of a session may be equal in it."""
    return index.groupBy("session_id").agg(
        F.max_by(F.struct("ts", "cwd", "reason"), F.struct(*order)).alias("_last")).select("session_id", "_last.*")


def write_dataset(rows: DataFrame, path: str) -> None:
    """Conversation records as JSON lines, one folder per ``split``."""
    rows.write.mode("overwrite").partitionBy("split").json(path)

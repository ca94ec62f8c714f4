"""The register: keeping its tables, resolving citations, merging candidates, reporting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions.text import clamp01, plain_number, report_cell, severity_band, strip
from casetrail.operators.findings import FINDING_COLUMNS, findings, metric_fqn, metrics, register_order, score
from casetrail.operators.ordering import numbered
from casetrail.session import stash

# --- tables ---------------------------------------------------------------------------------------------------------


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` of every ``key``. Combined map-side, so repeated keys cost nothing."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def upsert(stored: DataFrame, arriving: DataFrame, key: str = "fqn") -> DataFrame:
    """``stored`` with the rows of ``arriving`` added or replaced. ``arriving`` may carry ``load_seq``; last wins."""
    if "load_seq" not in arriving.columns:
        arriving = arriving.withColumn("load_seq", F.lit(0).cast("long"))
    old = stored.withColumn("load_seq", F.lit(-1).cast("long"))
    return latest(old.unionByName(arriving), key, "load_seq")


# --- citations ------------------------------------------------------------------------------------------------------


FEW_NAMES = 200_000
"""Cited names that are sent to the sources as they are."""
MOST_WORDS = 4_000_000
"""Words of 64 bits that a filter of names has at most; of more names it lets more strangers pass, never fewer names."""


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), "fqn"), F.lit(words))


def _mask() -> Column:
    """Four of the 64 bits of a name's word."""
    places = [F.pmod(F.xxhash64(F.lit(seed), "fqn"), F.lit(64)).cast("int") for seed in (1, 2, 3, 4)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def name_filter(names: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A Bloom filter of ``n`` names (``fqn``) as a table of words ``word, bits``, and how many words it is made for.

    All bits of a name are in one word, so a row is tested by one lookup. Two words for a name, up to ``MOST_WORDS``.
    """
    words = max(1, min(2 * n, MOST_WORDS))
    return names.groupBy(_word(words).alias("word")).agg(F.bit_or(_mask()).alias("bits")), words


def resolved_citations(cited: DataFrame, *sources: DataFrame, few: int = FEW_NAMES) -> DataFrame:
    """Which of the names in ``cited`` (one column, ``fqn``) occur in the ``fqn`` column of a source.

    The few cited names go to the large sources, not the other way round. More than ``few`` go there as a Bloom filter, and what
    passes it is joined with the names; the sources themselves are not shuffled.
    """
    names = stash(cited.where("fqn <> ''").distinct())
    known = reduce(DataFrame.unionByName, [source.select("fqn") for source in sources])
    n = names.count()
    if n <= few:
        return known.join(F.broadcast(names), "fqn", "left_semi").distinct()
    words, size = name_filter(names, n)
    tested = known.select("fqn", _word(size).alias("word"), _mask().alias("mask")).join(F.broadcast(stash(words)), "word")
    passed = tested.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("fqn").distinct()
    return passed.join(names, "fqn", "left_semi")


def event_fqns(events: DataFrame) -> DataFrame:
    return events.select(F.col("entity_fqn").alias("fqn"))


def first_entities(events: DataFrame, n: int = fixed.SAMPLE_ENTITIES) -> DataFrame:
    """The first ``n`` entity names of a log, as examples of what can be cited."""
    return event_fqns(events).where("fqn <> ''").distinct().orderBy("fqn").limit(n)


def with_grounding(rows: DataFrame, *sources: DataFrame, few: int = FEW_NAMES) -> DataFrame:
    """``rows`` with ``grounded``: whether ``evidence_fqn`` names an entity, a metric or an event's entity."""
    found = resolved_citations(rows.select(F.col("evidence_fqn").alias("fqn")), *sources, few=few)
    hits = found.select(F.col("fqn").alias("evidence_fqn"), F.lit(True).alias("grounded"))
    return rows.join(hits, "evidence_fqn", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def citation_gate(rows: DataFrame, *sources: DataFrame) -> DataFrame:
    return with_grounding(rows, *sources).where("grounded").drop("grounded")


def merge_candidates(candidates: DataFrame, detected: DataFrame, *sources: DataFrame) -> DataFrame:
    """Candidate findings that cite exactly their own metric, plus every detected finding they leave out.

    ``candidates`` has ``kind, title, key, severity, frequency, fixability, evidence_fqn``, scores as text or number.
    """
    own = candidates.where(F.col("evidence_fqn") == metric_fqn(F.col("kind"), F.col("key")))
    accepted = citation_gate(own, metrics(detected), *sources).select(
        F.lit(0).alias("detector_order"), "kind",
        F.substring(F.coalesce("title", F.lit("")), 1, fixed.TITLE_CHARS).alias("title"), "key",
        *[clamp01(F.col(c)).alias(c) for c in ("severity", "frequency", "fixability")], "evidence_fqn")
    accepted = accepted.withColumn("confidence", F.lit(1.0)).withColumn(
        "score", score(F.col("frequency"), F.col("severity"), F.col("fixability"))).select(*FINDING_COLUMNS)
    accepted = stash(accepted)
    return accepted.unionByName(safety_net(accepted, findings(detected)))


def safety_net(accepted: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected findings whose kind and key are not among the accepted ones."""
    return detected.join(accepted.select("kind", "key").distinct(), ["kind", "key"], "left_anti").select(
        *detected.columns)


# --- report ---------------------------------------------------------------------------------------------------------


def playbook(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.PLAYBOOK.items()), "kind string, recommendation string")


def ranked(rows: DataFrame) -> DataFrame:
    """The register with rank, priority and recommendation."""
    advised = rows.join(F.broadcast(playbook(rows.sparkSession)), "kind", "left").withColumns({
        "priority": severity_band(F.col("severity")),
        "recommendation": F.coalesce("recommendation", F.lit(fixed.PLAYBOOK_DEFAULT)),
    })
    return numbered(advised, register_order(), "rank")


def report_lines(rows: DataFrame, title: str) -> DataFrame:
    """The register as Markdown: ``part, rank, line_no, line``, in that order. An empty one says so."""
    ordered = ranked(rows)

    def lines(df: DataFrame, part: int, rank: Column, *texts: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), rank.alias("rank"),
                         F.posexplode(F.array(*texts)).alias("line_no", "line"))

    count = rows.agg(F.count(F.lit(1)).alias("n"))
    some = count.where("n > 0")
    first = F.lit(0).cast("long")
    heading = lines(count, 0, first, F.lit(fixed.REPORT_TITLE + title), F.lit(""))
    empty = lines(count.where("n = 0"), 1, first, F.lit(fixed.REPORT_EMPTY))
    intro = lines(some, 1, first, F.format_string(fixed.REPORT_INTRO, F.col("n").cast("string")), F.lit(""),
                  *[F.lit(line) for line in fixed.REPORT_TABLE])
    number, cell = F.col("rank").cast("string"), report_cell(F.col("title"))
    named, priority, evidence, advice = fixed.REPORT_SECTION
    entries = lines(ordered, 2, F.col("rank"), F.format_string(
        fixed.REPORT_ENTRY, number, "priority", cell, plain_number(F.col("score"))))
    gap = lines(some, 3, first, F.lit(""))
    sections = lines(
        ordered, 4, F.col("rank"), F.format_string(named, number, cell),
        F.format_string(priority, "priority", plain_number(F.col("severity")), plain_number(F.col("frequency"))),
        F.format_string(evidence, "evidence_fqn"), F.format_string(advice, "recommendation"), F.lit(""))
    return reduce(DataFrame.unionByName, [heading, empty, intro, entries, gap, sections])


def report_text(rows: DataFrame, title: str) -> DataFrame:
    """Only the lines, in reading order, ready for ``write.text``."""
    return report_lines(rows, title).orderBy("part", "rank", "line_no").select("line")


def fact_rows(stored: DataFrame, size: int | None = None) -> DataFrame:
    """The metrics by name as numbered JSON objects, one row each: ``rank, fact``; with ``size`` the first of them. The rows in
    order, in brackets and with commas between, are the fact pack as a document."""
    fact = F.to_json(F.struct(F.col("fqn").alias("evidence_fqn"), "name", "value", F.col("evidence_json").alias("detail")))
    if size is not None:
        stored = stored.orderBy("fqn").limit(size)
    return numbered(stored.select("fqn", fact.alias("fact")), ["fqn"], "rank").select("rank", "fact")


def fact_pack(stored: DataFrame, size: int = fixed.MOST_FACTS) -> DataFrame:
    """The first ``size`` metrics by name as one JSON text, ``n_facts, facts``, as a prompt takes them. :func:`fact_rows` has all."""
    fact = F.struct(F.col("fqn").alias("evidence_fqn"), "name", "value", F.col("evidence_json").alias("detail"))
    return stored.orderBy("fqn").limit(size).agg(
        F.count(F.lit(1)).alias("n_facts"), F.to_json(F.array_sort(F.collect_list(fact))).alias("facts"))


# --- proposals ------------------------------------------------------------------------------------------------------


def proposal_index(proposals: DataFrame) -> DataFrame:
    """Proposals per status."""
    return proposals.dropDuplicates(["id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pending_proposals(proposals: DataFrame) -> DataFrame:
    """The proposals that wait for a decision, each once: ``id, type, title``."""
    return proposals.where("status = 'pending'").dropDuplicates(["id"]).select("id", "type", "title")


def normal_key(key: Column) -> Column:
    return F.lower(strip(key))

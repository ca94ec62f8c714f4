"""Conversations as rows per turn (``conv_id, turn, role, text``) and as records with all messages.

Turn tables are handled without ever gathering a conversation: per-conversation facts are sums, minima and maxima,
and a conversation is identified by an order-free digest of its positioned messages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail import fixed_values as fixed
from casetrail.functions import messages as M
from casetrail.functions.rows import computed
from casetrail.functions.text import strip
from casetrail.operators.ordering import (
    Grouped,
    digest_text,
    numbered,
    order_free_digest,
    with_next,
    with_position,
    with_running_max,
)
from casetrail.session import broadcast_if_small, stash

CONV = "conv_id"


def turns_of(turns: DataFrame, long_keys: list | None = None) -> Grouped:
    return Grouped(turns, CONV, long_keys)


# --- the conversation contract --------------------------------------------------------------------------------------


def contract(turns: DataFrame) -> DataFrame:
    """One row per conversation: size, the first faulty turn and ``first_error`` (NULL for a valid conversation).

    Turn and fault travel in one number, so all aggregates are plain minima and maxima that combine map-side.
    """
    role = F.lower(strip(F.coalesce("role", F.lit(""))))
    known = role.isin(fixed.MESSAGE_ROLES)
    empty = strip(F.coalesce("text", F.lit(""))) == ""
    fault = F.when(~known, F.col("turn") * 2).when(empty, F.col("turn") * 2 + 1)
    ends = F.col("turn") * 2 + F.when(role == "assistant", 1).otherwise(0)
    facts = turns.groupBy(CONV).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(role == "assistant").alias("n_assistant"),
        F.min(fault).alias("_fault"), F.max(ends).alias("_ends"))
    error = (
        F.when(F.col("_fault") % 2 == 0, F.lit("invalid role"))
        .when(F.col("_fault") % 2 == 1, F.lit("empty content"))
        .when(F.col("n_messages") < 2, F.lit("fewer than two messages"))
        .when(F.col("n_assistant") == 0, F.lit("no assistant message"))
        .when(F.col("_ends") % 2 == 0, F.lit("does not end with an assistant message")))
    return facts.select(CONV, "n_messages", "n_assistant", F.floor(F.col("_fault") / 2).alias("faulty_turn"),
                        error.alias("first_error"))


def contract_errors(checked: DataFrame, most: int | None = None) -> DataFrame:
    """The faulty conversations, or the first ``most`` of them."""
    faulty = checked.where("first_error is not null")
    return faulty if most is None else faulty.orderBy(CONV).limit(most)


# --- shaping --------------------------------------------------------------------------------------------------------


def trim_to_assistant(turns: Grouped) -> Grouped:
    """Without the turns after the last assistant turn; conversations without one disappear."""

    def work(rows: DataFrame, is_long: bool) -> DataFrame:
        last = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
        if is_long:  # few conversations by construction, so their last turns fit everywhere
            ends = rows.groupBy(CONV).agg(last.alias("_last"))
            marked = rows.join(F.broadcast(ends), CONV)
        else:
            marked = rows.withColumn("_last", last.over(Window.partitionBy(CONV)))
        return marked.where("turn <= _last").drop("_last")

    return Grouped(turns.each(work), CONV, turns.long_keys)


def with_islands(turns: Grouped) -> Grouped:
    """Add ``first_turn``, the turn at which the run of the same role began."""

    def work(rows: DataFrame, is_long: bool) -> DataFrame:
        before = with_next(rows, CONV, [F.desc("turn")], {"_before": "role"}, is_long)
        starts = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("role")), F.col("turn"))
        marked = before.withColumn("_starts", starts).drop("_before")
        return with_running_max(marked, CONV, ["turn"], "_starts", "first_turn", is_long).drop("_starts")

    return Grouped(turns.each(work), CONV, turns.long_keys)


def run_pieces(turns: Grouped) -> Grouped:
    """Runs of one role, kept as their turns: ``conv_id, turn`` (the run's first), ``role, at`` (the piece's own turn), ``text``.

    A run of any length is that many rows; nothing is gathered.
    """
    pieces = with_islands(turns).rows.select(CONV, F.col("first_turn").alias("turn"), "role", F.col("turn").alias("at"), "text")
    return Grouped(pieces, CONV, turns.long_keys)


def runs(pieces: Grouped) -> DataFrame:
    """What a run is once its pieces are joined by line breaks: ``conv_id, turn, role, n_turns, n_chars`` and a ``digest`` that is equal
    for equal pieces at equal turns. Sums that combine before the shuffle."""
    digests = order_free_digest(F.col("at"), F.col("text"))
    summed = pieces.rows.groupBy(CONV, "turn", "role").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("_chars"), *digests)
    return summed.select(CONV, "turn", "role", "n_turns", (F.col("_chars") + F.col("n_turns") - 1).alias("n_chars"),
                         digest_text(F.col("n_turns")).alias("digest"))


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each run's joined text, from pieces in order."""
    key, digest = None, None

    def found(runs: list) -> pa.RecordBatch:
        conv, turn, role, text = zip(*runs)
        return pa.RecordBatch.from_arrays([pa.array(conv, types[0]), pa.array(turn, types[1]), pa.array(role, pa.string()),
                                           pa.array(text, pa.string())], [CONV, "turn", "role", "digest"])

    for batch in batches:
        done, types = [], (batch.schema.field(CONV).type, batch.schema.field("turn").type)
        columns = [batch.column(c).to_pylist() for c in (CONV, "turn", "role", "text")]
        for *own, text in zip(*columns):
            if own != key:
                if key is not None:
                    done.append((*key, digest and digest.hexdigest()))
                key, digest = own, None
            if text is not None:
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode())
        if done:
            yield found(done)
    if key is not None:
        yield found([(*key, digest and digest.hexdigest())])


def digested_runs(pieces: Grouped) -> DataFrame:
    """:func:`runs` with the digest of the joined text (SHA-256, see :func:`joined_runs`; none without a text) as ``digest`` and that of
    the pieces as ``pieces``. The text is read piece after piece in its order, so a run of any length is never one value."""
    run = [CONV, "turn", "role"]
    ordered = pieces.rows.select(*run, "at", "text").repartition(*run).sortWithinPartitions(*run, "at", F.asc_nulls_last("text"))
    schema = pieces.rows.select(*run, F.lit("").alias("digest")).schema
    digests = ordered.mapInArrow(_joined_digests, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    counted = runs(pieces).withColumnRenamed("digest", "pieces")
    same = reduce(lambda a, b: a & b, [counted[c].eqNullSafe(digests[c]) for c in run])
    return counted.join(digests, same).select(*[counted[c] for c in counted.columns], digests["digest"])


def joined_runs(pieces: Grouped) -> Grouped:
    """Runs with their text in one value, as a dataset record has them: ``conv_id, turn, role, text, n_turns``."""
    text = F.array_sort(F.collect_list(F.struct("at", "text"))).getField("text")
    joined = pieces.rows.groupBy(CONV, "turn").agg(
        F.any_value("role").alias("role"), F.array_join(text, "\n").alias("text"), F.count(F.lit(1)).alias("n_turns"))
    return Grouped(joined, CONV, pieces.long_keys)


def merge_turns(turns: Grouped) -> Grouped:
    """Consecutive turns of one role as one, texts joined by line breaks. For writing records; :func:`runs` needs no joined text."""
    return joined_runs(run_pieces(turns))


# --- identity, duplicates, splits -----------------------------------------------------------------------------------


def fingerprints(turns: Grouped) -> DataFrame:
    """``conv_id, n_messages, fingerprint``: equal for equal sequences of roles and trimmed texts."""
    placed = turns.each(lambda rows, is_long: with_position(
        rows.select(CONV, "turn", "role", "text"), CONV, ["turn"], "position", is_long))
    digests = order_free_digest(F.col("position"), F.col("role"), strip(F.col("text")))
    summed = placed.groupBy(CONV).agg(F.count(F.lit(1)).alias("n_messages"), *digests)
    return summed.select(CONV, "n_messages", digest_text(F.col("n_messages")).alias("fingerprint"))


def first_copies(entries: DataFrame, order: str) -> DataFrame:
    """``status`` 'written' for the first row (by the number ``order``, unique) of every fingerprint, else 'duplicate'.

    The first of every group is found map-side and looked up by ``order``, which no two rows share, so a group of
    copies of any size spreads over all tasks.
    """
    firsts = entries.groupBy("fingerprint").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    return entries.join(firsts, order, "left").withColumn(
        "status", F.when(F.col("_first"), "written").otherwise("duplicate")).drop("_first")


def split_of(fingerprint: Column, eval_fraction: float = fixed.EVAL_FRACTION, seed: int = fixed.SPLIT_SEED) -> Column:
    """``train`` or ``eval`` by a hash: the same for the same content, whatever else is in the set."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), fingerprint), 256)
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1_000_000
    return F.when(draw < int(round(eval_fraction * 1_000_000)), "eval").otherwise("train")


def with_held_out(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training rows with ``held_out``: whether their fingerprint occurs in the held-out rows.

    A fingerprint that many training rows share is looked up once: the distinct ones meet the held-out ones, and only
    those that do go back to the rows.
    """
    met = train.select("fingerprint").distinct().join(held_out.select("fingerprint").distinct(), "fingerprint", "left_semi")
    marked = broadcast_if_small(met.withColumn("_met", F.lit(True)))
    return train.join(marked, "fingerprint", "left").withColumn("held_out", F.coalesce("_met", F.lit(False))).drop("_met")


def decontaminate(train: DataFrame, held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows whose fingerprint does not occur in the held-out rows, and the number removed."""
    flagged = with_held_out(train, held_out)
    return flagged.where("not held_out").drop("held_out"), flagged.agg(F.count_if("held_out").alias("n_removed"))


def dataset_card(rows: DataFrame) -> DataFrame:
    """Rows per source and split with the source's share of all rows."""
    per_source = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "eval").alias("n_eval"))
    total = per_source.agg(F.sum("n_rows")).scalar()
    return per_source.withColumn("share", F.round(F.col("n_rows") / total, 4))


def source_stats(rows: DataFrame) -> DataFrame:
    """Rows per source and status."""
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


# --- records with all messages --------------------------------------------------------------------------------------


def to_records(turns: Grouped, min_turns: int = 1) -> DataFrame:
    """Conversations of at least ``min_turns`` turns as one row with ``messages``. A record is one line of a dataset file
    and one value here, whatever its length."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    records = turns.rows.groupBy(CONV).agg(F.count(F.lit(1)).alias("n_messages"), ordered.alias("_ordered"))
    messages = F.transform("_ordered", lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return records.where(F.col("n_messages") >= min_turns).select(CONV, "n_messages", messages.alias("messages"))


def ready_sources(sources: list[dict]) -> list[dict]:
    """Enabled sources; one without a verified license stops the collection."""
    ready = []
    for order, source in enumerate(sources):
        if not source.get("enabled", True):
            continue
        license_name = str(source.get("license", "")).strip()
        if not license_name:
            raise ValueError(f"source {source['name']!r} states no license")
        if license_name.startswith("check-"):
            raise ValueError(f"source {source['name']!r} has a license nobody has checked yet ({license_name})")
        ready.append({**source, "source_order": order})
    return ready


def read_sources(spark, sources: list[dict]) -> DataFrame:
    """Dataset rows of all ready sources: ``source_order, entry, source, license, notes, file, place, row``.

    ``entry`` (source, then a number that rises by file name and place) names and orders the rows. A source's ``limit``
    counts its raw rows.
    """
    from casetrail.sources.files import FILE, file_offsets, with_ingest_seq
    from casetrail.sources.jsonl import read_lines, strict_rows

    parts = []
    for source in ready_sources(sources):
        if source.get("type", "local_jsonl") != "local_jsonl":
            raise ValueError(f"source {source['name']!r} is of a kind that cannot be read: {source['type']}")
        lines = with_ingest_seq(read_lines(spark, source["path"]), F.col("place"), file_offsets(spark, source["path"]), "seq")
        if source.get("limit") is not None:
            lines = numbered(lines, ["seq"], "_number").where(F.col("_number") <= int(source["limit"])).drop("_number")
        rows = strict_rows(lines)
        parts.append(rows.select(
            F.lit(source["source_order"]).alias("source_order"),
            F.struct(F.lit(source["source_order"]).alias("source_order"), "seq").alias("entry"),
            F.lit(source["name"]).alias("source"), F.lit(source["license"]).alias("license"),
            F.lit(source.get("notes")).cast("string").alias("notes"), F.col(FILE).alias("file"), "place", "row"))
    return reduce(DataFrame.unionByName, parts)


def collect_records(rows: DataFrame, eval_fraction: float = fixed.EVAL_FRACTION, seed: int = fixed.SPLIT_SEED,
                    max_total: int | None = None) -> DataFrame:
    """Checked, de-duplicated and split records with a ``status``: written, bad or duplicate; ``error`` says why a row is
    bad, ``file`` and ``place`` where it stands.

    With ``max_total``, reading stops where that many have been written; what follows has no status and is left out.
    """
    kept = [c for c in rows.columns if c != "row"]
    raw = computed(rows, kept, F.struct(M.row_messages(F.col("row")).alias("raw")))
    checked = computed(raw, [*kept, "raw"], F.struct(M.first_error(F.col("raw")).alias("error")))
    tidied = computed(checked, [*kept, "error"], F.struct(
        F.when(F.col("error").isNull(), M.tidy(F.col("raw"))).alias("messages")))
    named = computed(tidied, [*kept, "error", "messages"], F.struct(M.fingerprint(F.col("messages")).alias("fingerprint")))
    narrow = stash(named.where("error is null").select("entry", "fingerprint"))
    copies = stash(first_copies(narrow, "entry").where("status = 'duplicate'").select("entry", F.lit(True).alias("_copy")))
    marked = named.join(broadcast_if_small(copies), "entry", "left")
    status = F.when(F.col("error").isNotNull(), "bad").when(F.col("_copy"), "duplicate").otherwise("written")
    records = marked.withColumn("status", status).drop("_copy").withColumn("split", F.when(
        F.col("status") == "written", split_of(F.col("fingerprint"), eval_fraction, seed)))
    if max_total is None:
        return records
    written = narrow.join(broadcast_if_small(copies), "entry", "left_anti").select("entry")
    end = numbered(written, ["entry"], "_number").where(F.col("_number") == max_total).first()
    if end is None:
        return records
    order, seq = end["entry"]["source_order"], end["entry"]["seq"]
    return records.where((F.col("entry.source_order") < order) | (
        (F.col("entry.source_order") == order) & (F.col("entry.seq") <= seq)))


def record_lines(records: DataFrame) -> DataFrame:
    """Written records in the shape of the dataset files, with their split."""
    return records.where("status = 'written'").select("messages", "source", "license", "notes", "split")


def score_answers(answers: DataFrame) -> DataFrame:
    """Share of outputs (``output, expect array<string>``) that contain everything expected."""
    checked = answers.withColumn("passed", M.expected_found(F.col("output"), F.col("expect")))
    return checked.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))

"""Agent-session transcripts: statistics, triage, recurrence, and conversion to conversations.

Input are transcript rows ``session_id, place, row`` (:mod:`casetrail.sources.jsonl`). Everything about a line is
computed on the line; sessions are only ever added up, so a session of any size is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions import messages as M
from casetrail.functions.rows import computed
from casetrail.functions.scrub import hits, redact, redact_counted, scrub_counted
from casetrail.functions.text import collapse, session_class, strip, truncated
from casetrail.operators.conversations import CONV, merge_turns, to_records, trim_to_assistant
from casetrail.operators.ordering import Grouped, with_position, with_running_sum
from casetrail.session import broadcast_if_small, stash

SESSION = "session_id"


def message_lines(transcript: DataFrame) -> DataFrame:
    """Transcript rows with their message taken apart: ``role, content, blocks, plain, said``."""
    kept = [c for c in transcript.columns if c != "row"]
    read = computed(transcript, kept, M.opened(F.col("row")))
    typed = computed(read, [*kept, "role", "content"], F.struct(M.typed_blocks(F.col("content")).alias("blocks")))
    plain = F.when(F.col("blocks").isNull(), M.only_text(F.col("content")))
    typed = computed(typed, [*kept, "role", "content", "blocks"], F.struct(plain.alias("plain")))
    joined = F.array_join(M.text_parts(F.col("blocks")), " ")
    return computed(typed, [*kept, "role", "content", "blocks", "plain"],
                    F.struct(F.coalesce("plain", joined, F.lit("")).alias("said")))


def _line_facts(transcript: DataFrame) -> DataFrame:
    readable = F.col("row").isNotNull().alias("readable")
    lines = message_lines(transcript.select(SESSION, "place", "row", readable))
    blocks = F.coalesce("blocks", F.expr("array()").cast(lines.schema["blocks"].dataType))
    from_user, from_agent = F.col("role") == "user", F.col("role") == "assistant"
    calls = F.transform(M.blocks_of_type(blocks, "tool_use"), lambda b: F.coalesce(b.getField("name"), F.lit("?")))
    errors = F.transform(M.blocks_of_type(blocks, "tool_result"), lambda b: b.is_error)
    sorted_out = computed(lines, [SESSION, "place", "readable", "said", "role"], F.struct(
        from_agent.alias("from_agent"),
        F.when(from_agent, calls).otherwise(F.array().cast("array<string>")).alias("calls"),
        F.when(from_user, errors).otherwise(F.array().cast("array<boolean>")).alias("results")))
    spoken = (F.col("role") == "user") & (F.size("results") == 0) & (strip(F.col("said")) != "")
    kept = [SESSION, "place", "readable", "said", "from_agent", "calls", "results"]
    lines = computed(sorted_out, kept, F.struct(
        F.when(spoken, M.is_injected(F.col("said"))).alias("injected")))
    lines = computed(lines, [*kept, "injected"], F.struct(
        (~F.col("injected") & M.is_correction(F.col("said"))).alias("correction")))
    no = F.lit(False)
    return lines.select(
        SESSION, "place", "readable", "said", "from_agent", "calls", F.coalesce("injected", no).alias("injected"),
        F.coalesce(~F.col("injected"), no).alias("human"), F.coalesce("correction", no).alias("correction"),
        F.size("results").alias("n_results"), F.size(F.filter("results", lambda r: r)).alias("n_errors"))


def session_stats(transcript: DataFrame) -> DataFrame:
    """One row of counts per session. Rows that could not be read (``row`` is NULL) only make the session known."""
    mutations = F.size(F.filter("calls", lambda c: c.isin(fixed.MUTATION_TOOLS)))
    lines = _line_facts(transcript).select(
        SESSION, "readable", "human", "injected", "from_agent", "n_results", "n_errors", "correction",
        F.size("calls").alias("uses"), mutations.alias("mutations"))
    return lines.groupBy(SESSION).agg(
        F.count_if("readable").alias("n_events"), F.count_if("human").alias("n_user_msgs"),
        F.count_if("injected").alias("n_injected"), F.count_if("from_agent").alias("n_assistant_msgs"),
        F.sum("n_results").alias("n_tool_results"), F.sum("n_errors").alias("n_tool_errors"),
        F.sum("uses").alias("n_tool_uses"), F.sum("mutations").alias("n_mutations"),
        F.count_if("correction").alias("n_corrections"))


def tool_counts(transcript: DataFrame) -> DataFrame:
    """Uses per session and tool: ``session_id, tool, n``."""
    calls = _line_facts(transcript).select(SESSION, F.explode("calls").alias("tool"))
    return calls.groupBy(SESSION, "tool").agg(F.count(F.lit(1)).alias("n"))


def first_rows(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group with their 1-based ``rank``. Spark keeps only ``k`` rows per group before
    it shuffles, so the size of a group does not matter."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def top_tools(counted: DataFrame, k: int = fixed.TOP_TOOLS) -> DataFrame:
    """The most used tools of every session from :func:`tool_counts`."""
    return first_rows(counted, SESSION, [F.desc("n"), F.asc("tool")], k)


def user_messages(transcript: DataFrame) -> DataFrame:
    """What people said: ``session_id, place, message, is_correction``, shortened."""
    lines = _line_facts(transcript).where("human")
    return lines.select(SESSION, "place", truncated(F.col("said"), fixed.USER_MESSAGE_CHARS).alias("message"),
                        F.col("correction").alias("is_correction"),
                        truncated(F.col("said"), fixed.CORRECTION_CHARS).alias("correction"))


def _sample(rows: DataFrame, column: str, k: int, name: str, clean) -> DataFrame:
    first = first_rows(rows, SESSION, ["place"], k).withColumn("line", F.concat(F.lit("- "), clean(F.col(column))))
    listed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return first.groupBy(SESSION).agg(F.array_join(listed.getField("line"), "\n").alias(name))


def excerpts(transcript: DataFrame, stats: DataFrame, redacted: bool = True) -> DataFrame:
    """A short text per session: its counts, its most used tools, first messages and corrections.

    ``stats`` is :func:`session_stats`, with ``cwd`` when known. Every free text is redacted unless told otherwise.
    """
    clean = redact if redacted else (lambda c: c)
    said = user_messages(transcript)
    tools = top_tools(tool_counts(transcript)).groupBy(SESSION).agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("rank", F.concat("tool", F.lit(":"), F.col("n").cast("string")).alias("t")))).getField("t"), ", ")
        .alias("tools"))
    sampled = (stats.join(tools, SESSION, "left")
               .join(_sample(said, "message", fixed.SAMPLE_MESSAGES, "messages", clean), SESSION, "left")
               .join(_sample(said.where("is_correction"), "correction", fixed.SAMPLE_CORRECTIONS, "corrections", clean),
                     SESSION, "left"))
    cwd = F.col("cwd") if "cwd" in stats.columns else F.lit("")
    place = clean(F.coalesce(F.nullif(cwd, F.lit("")), F.lit("unknown")))

    counts = [F.col(c).cast("string") for c in (
        "n_events", "n_user_msgs", "n_assistant_msgs", "n_tool_uses", "n_mutations", "n_tool_errors", "n_corrections")]
    facts = F.format_string(fixed.EXCERPT_FACTS, place, *counts, F.coalesce("tools", F.lit("none")))
    excerpt = F.format_string(fixed.EXCERPT, facts, F.coalesce("messages", F.lit("(none)")),
                              F.coalesce("corrections", F.lit("(none)")))
    return sampled.select(SESSION, excerpt.alias("excerpt"))


def tripwire(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are clean on a second scan, and the others with the number of residual hits."""
    scanned = rows.withColumn("residual", hits(redact_counted(F.col(column)).counts))
    return scanned.where("residual = 0").drop("residual"), scanned.where("residual > 0")


WINDOW_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 12
"""Characters of the text before a window that are scanned with it: no secret but a private key is longer."""
KEY_BEGIN, KEY_END = (rf"-----{word} [A-Z ]*PRIVATE KEY-----" for word in ("BEGIN", "END"))
_CUT_START, _CUT_END = r"\A\S{0,1024}[\d\s().+-]*", r"[\d\s().+-]*\S{0,1024}\z"


def secret_windows(texts: Grouped, order: str, column: str, size: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Groups whose texts, joined by line breaks in ``order``, hold something sensitive: the key and ``residual``, the number of windows
    with a hit, without joining them.

    Every text knows where it begins in the joined one. Windows of ``size`` characters, and ``overlap`` before them, are put together from
    the pieces of the texts that lie in them, so a task holds a window, whatever the length of a group. A word or a number that a
    window cuts is left to the next one. A private key may be longer than a window: one is there when a begin mark
    stands before an end mark.
    """
    key = texts.key

    def placed(rows: DataFrame, is_long: bool) -> DataFrame:
        sized = rows.select(key, order, F.col(column).alias("_text"), (F.length(column) + 1).cast("long").alias("_size"))
        return with_running_sum(sized, key, [order], "_size", "_start", is_long)

    rows = texts.each(placed).withColumn("_end", F.col("_start") + F.col("_size") - 1)
    # a window w is the text from w * size - overlap to (w + 1) * size
    last = F.floor((F.greatest("_end", F.col("_start") + 1) - 1 + overlap) / size)
    rows = rows.withColumn("_window", F.explode(F.sequence(F.floor(F.col("_start") / size), last)))
    opens = F.greatest(F.col("_window") * size - overlap, "_start")
    closes = F.least((F.col("_window") + 1) * size, F.col("_end"))
    part = F.substr("_text", (opens - F.col("_start") + 1).cast("int"), F.greatest(closes - opens, F.lit(0)).cast("int"))
    rows = rows.where(opens <= closes).select(
        key, "_window", F.struct(F.col("_start").alias("at"), part.alias("text")).alias("_part"),
        (F.col("_start") < F.col("_window") * size - overlap).alias("_cut_start"), (F.col("_end") > (F.col("_window") + 1) * size).alias("_cut_end"))
    windows = rows.groupBy(key, "_window").agg(
        F.array_join(F.array_sort(F.collect_list("_part")).getField("text"), "\n").alias("_text"),
        F.max("_cut_start").alias("_cut_start"), F.max("_cut_end").alias("_cut_end"))
    text = F.when(F.col("_cut_start"), F.regexp_replace("_text", _CUT_START, "")).otherwise(F.col("_text"))
    text = F.when(F.col("_cut_end"), F.regexp_replace(text, _CUT_END, "")).otherwise(text)
    offset = F.greatest(F.col("_window") * size - overlap, F.lit(0))
    begin = F.regexp_instr("_text", F.lit(KEY_BEGIN))
    end = F.length(F.regexp_extract("_text", rf"(?s)\A(.*{KEY_END})", 1))
    scanned = computed(windows, [key], F.struct(
        (hits(redact_counted(text).counts) > 0).alias("hit"), F.when(begin > 0, offset + begin).alias("begin"),
        F.when(end > 0, offset + end).alias("end")))
    found = scanned.groupBy(key).agg(F.count_if("hit").alias("_hits"), F.min("begin").alias("_begin"), F.max("end").alias("_end"))
    whole_key = F.coalesce(F.col("_begin") < F.col("_end"), F.lit(False))
    residual = F.when(F.col("_hits") > 0, F.col("_hits")).when(whole_key, 1).otherwise(0)
    return found.select(key, residual.cast("long").alias("residual")).where("residual > 0")


# --- triage ---------------------------------------------------------------------------------------------------------


def salience() -> Column:
    """How much there is to learn from a session, from its counts."""
    unsteered = (F.col("n_user_msgs") == 0) & (F.col("n_assistant_msgs") > 20)
    points = (F.least(F.lit(0.5), 0.25 * F.col("n_corrections")) + F.least(F.lit(0.3), 0.08 * F.col("n_tool_errors"))
              + F.least(F.lit(0.15), 0.01 * F.col("n_mutations")) + F.when(unsteered, 0.1).otherwise(0.0))
    return F.round(F.least(F.lit(1.0), points), 2)


def with_index(stats: DataFrame, index: DataFrame) -> DataFrame:
    """Session statistics with where and how the session ended (``cwd, end_reason, index_ts``)."""
    entries = index.select(SESSION, "cwd", F.col("reason").alias("end_reason"), F.col("ts").alias("index_ts"))
    joined = stats.join(entries, SESSION, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("cwd", "end_reason", "index_ts")})


def triage_records(stats: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One record per session. ``verdicts`` (``session_id, session_class, rule_drift, notes``) are judgements made
    elsewhere; a session without one stays pending."""
    for column in ("cwd", "index_ts"):
        if column not in stats.columns:
            stats = stats.withColumn(column, F.lit(""))
    if verdicts is None:
        judged = stats.withColumns({"session_class": F.lit(None).cast("string"), "rule_drift": F.lit(None).cast(
            "boolean"), "notes": F.lit(None).cast("string"), "judged": F.lit(False)})
    else:
        judged = stats.join(verdicts.withColumn("judged", F.lit(True)), SESSION, "left")
    done = F.coalesce("judged", F.lit(False))
    names = ["events", "human", "injected", "assistant", "tool_uses", "mutations", "tool_errors"]
    columns = ["n_events", "n_user_msgs", "n_injected", "n_assistant_msgs", "n_tool_uses", "n_mutations",
               "n_tool_errors"]
    return judged.select(
        F.col(SESSION).alias("id"), F.col("index_ts").alias("ts"), salience().alias("salience"),
        F.when(done, session_class(F.coalesce("session_class", F.lit("")))).otherwise("").alias("session_class"),
        F.struct(F.col("n_corrections").alias("corrections"), F.col("n_tool_errors").alias("errors"),
                 F.coalesce("rule_drift", F.lit(False)).alias("rule_drift"),
                 F.substring(collapse(F.coalesce("notes", F.lit(""))), 1, 300).alias("notes")).alias("signals"),
        F.col("cwd").alias("repo"), F.when(done, "ok").otherwise("pending").alias("status"),
        F.struct(*[F.col(c).alias(n) for n, c in zip(names, columns)]).alias("facts"))


def untriaged(sessions: DataFrame, journal: DataFrame) -> DataFrame:
    """Sessions without a finished record; a pending one is tried again."""
    done = journal.where("status = 'ok'").select(F.col("id").alias(SESSION)).distinct()
    return sessions.join(done, SESSION, "left_anti")


def recurrence(signals: DataFrame, at_least: int = fixed.RECURRENCE_MIN) -> DataFrame:
    """Signals (``session_id, signal``) seen in enough sessions."""
    pairs = signals.groupBy("signal", SESSION).agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("signal").agg(F.count(F.lit(1)).alias("n_sessions"))
    return counted.where(F.col("n_sessions") >= at_least)


def with_recurrence(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Triage records with ``recurrence``: in how many sessions their most frequent signal occurs; 0 without one.

    ``signals`` (``session_id, signal``) are counted over all sessions. A signal that many sessions share meets its count
    by key; only signals of at least two sessions are counted as such, the others count 1.
    """
    own = signals.select(F.col(SESSION).alias("id"), "signal").distinct()
    counted = own.groupBy("signal").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    most = own.join(broadcast_if_small(counted), "signal", "left").groupBy("id").agg(
        F.max(F.coalesce("n", F.lit(1))).alias("recurrence"))
    return records.join(most, "id", "left").withColumn("recurrence", F.coalesce("recurrence", F.lit(0)))


def is_escalated() -> Column:
    """Whether a record is worth a closer look: salient on its own, or with a signal that recurs in enough sessions."""
    return (F.col("salience") >= fixed.SALIENCE_THRESHOLD) | (F.col("recurrence") >= fixed.RECURRENCE_MIN)


def escalated(records: DataFrame) -> DataFrame:
    """The records of :func:`with_recurrence` worth a closer look."""
    return records.where(is_escalated())


def triage_summary(records: DataFrame, done_before: DataFrame) -> DataFrame:
    """One row: sessions finished, pending and already done."""
    already = done_before.agg(F.count(F.lit(1))).scalar()
    return records.agg(F.count_if(F.col("status") == "ok").alias("ok"),
                       F.count_if(F.col("status") == "pending").alias("pending")).withColumn("already_done", already)


# --- conversion -----------------------------------------------------------------------------------------------------


def transcript_turns(transcript: DataFrame) -> Grouped:
    """Dataset turns of transcripts: ``conv_id`` (the session), ``turn, role, text``, numbered as they were said."""
    lines = message_lines(transcript).where("role in ('assistant', 'user')")
    # the blocks' inputs once more as text, because VARIANT sorts the keys of objects
    spelled = F.from_json(F.to_json("content"), "array<struct<input:string>>")
    if "line" in lines.columns:
        whole = "content array<struct<input:string>>"
        direct = F.from_json("line", f"message struct<{whole}>").getField("message").getField("content")
        flat = F.from_json("line", whole).getField("content")
        spelled = F.coalesce(direct, flat, spelled)
    inputs = F.transform(F.coalesce(spelled, F.array().cast("array<struct<input:string>>")), lambda s: s.input)
    blocks = F.coalesce("blocks", F.expr("array()").cast(lines.schema["blocks"].dataType))
    told = M.line_messages(F.col("role"), blocks, F.col("plain"), F.col("said"), F.col("inputs"))
    said = computed(computed(lines, ["*"], F.struct(inputs.alias("inputs"))), [SESSION, "place"],
                    F.struct(told.alias("told")))
    each = said.select(SESSION, "place", F.posexplode("told").alias("at", "m"))
    ordered = Grouped(each.select(F.col(SESSION).alias(CONV), "place", "at", "m.role", F.col("m.content").alias("text")),
                      CONV)
    return Grouped(ordered.each(lambda rows, is_long: with_position(rows, CONV, ["place", "at"], "turn", is_long))
                   .select(CONV, "turn", "role", "text"), CONV, ordered.long_keys)


def convert_transcripts(transcript: DataFrame, source: str, min_turns: int = 4) -> tuple[DataFrame, DataFrame]:
    """Transcripts as redacted conversation records, and those blocked.

    Runs of one role are merged, what follows the last assistant turn is dropped, every text is redacted. A record
    whose joined text still trips the redactor is blocked, whatever its length: a secret may lie over any number of turns.
    """
    merged = merge_turns(trim_to_assistant(transcript_turns(transcript)))
    clean = Grouped(stash(merged.rows.withColumn("text", redact(F.col("text")))), CONV, merged.long_keys)
    records = to_records(clean, min_turns)
    caught = secret_windows(clean, "turn", "text")
    passed = records.join(caught.select(CONV), CONV, "left_anti")
    described = passed.select(
        CONV, "messages", F.lit(source).alias("source"), F.lit("internal").alias("license"),
        F.concat(F.lit("redacted trajectory from "), CONV).alias("notes"))
    return described, records.select(CONV).join(caught, CONV)


def redaction_audit(documents: DataFrame, column: str) -> DataFrame:
    """Documents, those that held something sensitive, and those that still do after one redaction."""
    first = documents.select(redact_counted(F.col(column)).alias("first"))
    second = first.select(F.col("first.counts").alias("counts"), redact_counted(F.col("first.text")).alias("second"))
    return second.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(hits(F.col("counts")) > 0).alias("held_secrets"),
        F.count_if(hits(F.col("second.counts")) > 0).alias("leaks"))


def redaction_counts(documents: DataFrame, column: str) -> DataFrame:
    """Hits per kind over all documents."""
    counted = documents.select(F.explode(scrub_counted(F.col(column)).counts).alias("kind", "n"))
    return counted.groupBy("kind").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_documents"))

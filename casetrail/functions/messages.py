"""Column functions for chat messages: transcript lines, content blocks, dataset row shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions.text import lstrip, once, strip

MESSAGE_ARRAY = "array<struct<role string, content string>>"


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def field(value: Column, name: str) -> Column:
    """A member of an object, NULL for anything else."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def only_text(value: Column) -> Column:
    return F.when(is_text(value), text(value))


def items(value: Column) -> Column:
    """Entries of a list, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


# --- transcript lines -----------------------------------------------------------------------------------------------


def opened(row: Column) -> Column:
    """``struct<role, content>`` of a transcript line, whose message may be nested or the line itself."""
    def read(message: Column) -> Column:
        return F.struct(F.coalesce(text(field(message, "role")), F.lit("")).alias("role"),
                        field(message, "content").alias("content"))

    return once(F.coalesce(field(row, "message"), row), read)


def typed_blocks(content: Column) -> Column:
    """Blocks of a content list as ``struct<type, name, text, is_error, body>``; NULL when it is not a list."""
    def typed(block: Column) -> Column:
        return F.struct(
            text(field(block, "type")).alias("type"), text(field(block, "name")).alias("name"),
            only_text(field(block, "text")).alias("text"),
            F.coalesce(F.try_variant_get(block, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
            field(block, "content").alias("body"))

    return F.transform(items(content), typed)


def blocks_of_type(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: b.type == kind)


def text_parts(blocks: Column) -> Column:
    """Texts of typed blocks."""
    return F.transform(F.filter(blocks, lambda b: (b.type == "text") & b.text.isNotNull()), lambda b: b.text)


def said_in(content: Column, blocks: Column) -> Column:
    """Text of a message: its text blocks joined by blanks, or the content itself when that is a string."""
    return F.when(blocks.isNotNull(), F.array_join(text_parts(blocks), " ")).otherwise(
        F.coalesce(only_text(content), F.lit("")))


def flat_text(content: Column) -> Column:
    return once(F.struct(content.alias("content"), typed_blocks(content).alias("blocks")),
                lambda m: said_in(m.content, m.blocks))


def is_injected(message: Column) -> Column:
    """A user turn that tools put there, by how it starts."""
    start = lstrip(message)
    head = F.lower(F.substring(start, 1, 64))
    wide = F.lower(F.substring(start, 1, 400))
    test = start.rlike("(?iU)" + fixed.SKILL_TITLE_PATTERN)
    for prefix in fixed.INJECTED_PREFIXES:
        test = test | head.startswith(prefix)
    for marker in fixed.INJECTED_MARKERS:
        test = test | F.contains(wide, F.lit(marker))
    return test


def is_injected_for_dataset(message: Column) -> Column:
    head = F.substring(lstrip(message), 1, 200)
    test = F.lit(False)
    for marker in fixed.INJECTED_DATASET_MARKERS:
        test = test | F.contains(head, F.lit(marker))
    return test


def is_correction(message: Column) -> Column:
    return message.rlike("(?iU)" + fixed.CORRECTION_PATTERN)


def spaced_json(json: Column) -> Column:
    """Compact JSON with a blank after every comma and colon between values."""
    tokens = F.regexp_extract_all(json, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)),
                        "")


def line_messages(role: Column, blocks: Column, plain: Column, said: Column, inputs: Column) -> Column:
    """The dataset messages of one transcript line, ``array<struct<role,content>>``.

    An assistant turn is its texts and its tool calls, one per line; a user turn is each of its tool results, or its
    text unless a tool put it there. ``plain`` is the content when it is a string, ``inputs`` are the blocks' inputs
    as JSON texts.
    """
    none = F.array().cast("array<string>")
    results = blocks_of_type(blocks, "tool_result")

    def call(block: Column, i: Column) -> Column:
        given = spaced_json(F.coalesce(F.try_element_at(inputs, i + 1), F.lit("{}")))
        name = F.coalesce(block.getField("name"), F.lit("tool"))
        return F.when(block.type == "tool_use", F.concat(F.lit("→ "), name, F.lit("("), given, F.lit(")")))

    own = F.when(plain.isNotNull(), F.array(plain)).otherwise(text_parts(blocks))
    calls = F.filter(F.transform(blocks, call), lambda c: c.isNotNull())
    reply = once(strip(F.array_join(F.concat(own, calls), "\n")),
                 lambda t: F.when(t != "", F.array(t)).otherwise(none))
    told = F.filter(F.transform(results, lambda b: strip(flat_text(b.body))), lambda t: t != "")
    told = F.transform(told, lambda t: F.concat(
        F.lit(fixed.TOOL_RESULT_PREFIX), F.substring(t, 1, fixed.TOOL_RESULT_CHARS)))
    spoken = once(strip(said), lambda t: F.when((t != "") & ~is_injected_for_dataset(t), F.array(t)).otherwise(none))
    contents = (F.when(role == "assistant", reply)
                .when((role == "user") & (F.size(results) > 0), told)
                .when(role == "user", spoken).otherwise(none))
    return F.transform(contents, lambda c: F.struct(role.alias("role"), c.alias("content")))


# --- dataset rows ---------------------------------------------------------------------------------------------------


def _raw(role: Column, content: Column) -> Column:
    """A message before checking; ``content`` is NULL unless it was text."""
    return F.struct(F.lower(strip(F.coalesce(role, F.lit("")))).alias("role"), content.alias("content"))


def _mapped(role: Column) -> Column:
    name = F.lower(strip(F.coalesce(role, F.lit(""))))
    mapped = None
    for alias, known in fixed.ROLE_ALIASES.items():
        mapped = (F if mapped is None else mapped).when(name == alias, known)
    return mapped.otherwise(name)


def row_messages(row: Column) -> Column:
    """Raw messages of a dataset row in any of its four shapes, NULL for another shape."""
    messages, conversations = field(row, "messages"), field(row, "conversations")
    instruction, output, extra = field(row, "instruction"), field(row, "output"), field(row, "input")
    prompt, response, completion = field(row, "prompt"), field(row, "response"), field(row, "completion")
    asked = strip(F.coalesce(text(instruction), F.lit("")))
    more = F.coalesce(text(extra), F.lit(""))
    asked = F.when(more != "", strip(F.concat(asked, F.lit("\n\n"), more))).otherwise(asked)
    return (
        F.when(items(messages).isNotNull(), F.transform(items(messages), lambda m: _raw(
            text(field(m, "role")), only_text(field(m, "content")))))
        .when(items(conversations).isNotNull(), F.transform(items(conversations), lambda m: _raw(
            _mapped(F.coalesce(text(field(m, "role")), text(field(m, "from")))),
            only_text(F.coalesce(field(m, "value"), field(m, "content"))))))
        .when(instruction.isNotNull() & output.isNotNull(), F.array(
            _raw(F.lit("user"), asked), _raw(F.lit("assistant"), only_text(output))))
        .when(prompt.isNotNull() & (response.isNotNull() | completion.isNotNull()), F.array(
            _raw(F.lit("user"), only_text(prompt)),
            _raw(F.lit("assistant"), only_text(F.coalesce(response, completion))))))


def first_error(messages: Column) -> Column:
    """Why raw messages are not a valid conversation, NULL when they are."""
    def fault(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("message "), i.cast("string"))
        return (F.when(~m.role.isin(fixed.MESSAGE_ROLES), F.concat(at, F.lit(" has invalid role")))
                .when(F.coalesce(strip(m.content), F.lit("")) == "", F.concat(at, F.lit(" has empty content"))))

    faults = F.filter(F.transform(messages, fault), lambda f: f.isNotNull())
    last = F.try_element_at(messages, F.lit(-1))
    return (
        F.when(messages.isNull(), F.lit("unsupported row shape"))
        .when(F.size(faults) > 0, F.try_element_at(faults, F.lit(1)))
        .when(F.size(messages) < 2, F.lit("fewer than two messages"))
        .when(~F.exists(messages, lambda m: m.role == "assistant"), F.lit("no assistant message"))
        .when(last.getField("role") != "assistant", F.lit("does not end with an assistant message")))


def tidy(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m.role.alias("role"), strip(m.content).alias("content")))


def fingerprint(messages: Column) -> Column:
    """SHA-256 of the messages as compact JSON with sorted keys."""
    ordered = F.transform(messages, lambda m: F.struct(m.content.alias("content"), m.role.alias("role")))
    return F.sha2(F.to_json(ordered), 256)


def expected_found(output: Column, expected: Column) -> Column:
    """Whether every expected text occurs in the output, ignoring case; without expectations it passes."""
    found = F.forall(expected, lambda e: F.contains(F.lower(output), F.lower(e)))
    return F.coalesce(found, F.lit(True))

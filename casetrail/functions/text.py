"""Column functions for text and numbers in registers and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed

# what counts as whitespace, and the same as a character class
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
BLANK_RUN = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without whitespace of any kind (not only blanks) at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, BLANK_RUN, " "))


def truncated(text: Column, n: int) -> Column:
    """Collapsed text of at most ``n`` characters, the last one an ellipsis when something was cut."""
    return once(collapse(text), lambda flat: F.when(F.length(flat) <= n, flat).otherwise(
        F.concat(F.substring(flat, 1, n - 1), F.lit("…"))))


def clamp01(value: Column) -> Column:
    """A score from text: kept within 0..1, 0.5 when it is not a finite number."""
    text = value.cast("string")
    numeric = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    number = F.when(numeric, F.trim(text).try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))).otherwise(F.lit(0.5))


def severity_band(severity: Column) -> Column:
    floors = iter(fixed.SEVERITY_BANDS)
    floor, label = next(floors)
    band = F.when(severity >= floor, label)
    for floor, label in floors:
        band = band.when(severity >= floor, label)
    return band.otherwise(fixed.LOWEST_BAND)


def report_cell(text: Column) -> Column:
    """Safe in a Markdown table and in a spreadsheet: pipes escaped, one line, formula starts quoted."""
    flat = F.translate(F.replace(text, F.lit("|"), F.lit("\\|")), "\n\r", "  ")
    return F.when(F.substring(flat, 1, 1).isin(fixed.FORMULA_LEADS), F.concat(F.lit("'"), flat)).otherwise(flat)


def plain_number(value: Column) -> Column:
    """A double as shortest decimal text, without an exponent."""
    places = F.regexp_replace(F.format_string("%.12f", value), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(value) >= 0.001) & (F.abs(value) < 1e7), value.cast("string")).otherwise(places)


def proposal_id(finding: Column, kind: Column, title: Column, body: Column) -> Column:
    """Twelve hexadecimal digits that name a proposal by its content. A missing part reads ``None``."""
    parts = [F.coalesce(p, F.lit("None")) for p in (finding, kind, title, body)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def proposal_route(kind: Column) -> Column:
    return F.when(kind.isin(fixed.QUEUED_TYPES), "queue").otherwise("auto")


def clean_artifacts(artifacts: Column) -> Column:
    """The first three entries of ``array<struct<type,title,rationale,body>>``, of those the known types, tidied."""
    first = F.slice(artifacts, 1, fixed.ARTIFACT_CAP)
    typed = F.transform(first, lambda a: F.struct(
        F.lower(strip(F.coalesce(a.type, F.lit("")))).alias("type"),
        F.substring(strip(F.coalesce(a.title, F.lit(""))), 1, 120).alias("title"),
        F.substring(strip(F.coalesce(a.rationale, F.lit(""))), 1, 500).alias("rationale"),
        F.coalesce(a.body, F.lit("")).alias("body")))
    return F.filter(typed, lambda a: a.type.isin(fixed.ARTIFACT_TYPES))


def session_class(name: Column) -> Column:
    known = F.lower(strip(name))
    return F.when(known.isin(fixed.SESSION_CLASSES), known).otherwise("other")


def embedded_json(text: Column, greedy: bool = False) -> Column:
    """The JSON object inside a reply: the fenced block if there is one, else from the first to the last brace."""
    inner = r"\{.*\}" if greedy else r"\{.*?\}"
    fence = rf"(?s)```(?:json)?\s*({inner})\s*```"
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substr(text, start, end - start + 1))
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(F.coalesce(braces, text))

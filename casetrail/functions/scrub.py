"""Removing personal data and credentials from text, as column expressions.

Payment cards and phone numbers go first, then the credential rules, each on the text the previous one left. Text
between placeholders that are already there is scrubbed piece by piece, so scrubbing twice changes nothing more.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions.text import once

KINDS = [fixed.CARD_KIND, fixed.PHONE_KIND, *[rule[0] for rule in fixed.CREDENTIAL_RULES]]
_KEEPS_NAME = "secret-assignment"


def placeholder(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def java_pattern(pattern: str, flags: str) -> str:
    """Character classes match all scripts and only a line feed ends a line."""
    return f"(?Ud{flags}){pattern}"


def _luhn_valid(match: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(match, "[^0-9]", ""))


def _cards(piece: Column) -> Column:
    """Only candidates that pass the check digit are replaced, so text and matches are taken apart and rejoined."""
    pattern = F.lit(java_pattern(fixed.CARD_PATTERN, ""))
    matches = F.regexp_extract_all(piece, pattern, F.lit(0))
    shown = F.transform(matches, lambda m: F.when(_luhn_valid(m), placeholder(fixed.CARD_KIND)).otherwise(m))
    between = F.split(piece, java_pattern(fixed.CARD_PATTERN, ""), -1)
    return F.array_join(F.zip_with(between, shown, lambda text, m: F.concat(text, F.coalesce(m, F.lit("")))), "")


def _card_count(piece: Column) -> Column:
    matches = F.regexp_extract_all(piece, F.lit(java_pattern(fixed.CARD_PATTERN, "")), F.lit(0))
    return F.size(F.filter(matches, _luhn_valid))


# cheap tests that every match of a rule passes, for rules that contain no fixed substring
_TESTS = {
    fixed.PHONE_KIND: lambda t: t.rlike(r"(?U)\d[\d .()-]{4,}\d"),
    "authorization": lambda t: F.contains(t, F.lit(":")),
    "secret-assignment": lambda t: (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(
        "(?iU)KEY|TOKEN|SECRET|PASSW|PWD|CREDENTIAL|AUTH"),
    "high-entropy": lambda t: t.rlike("[A-Za-z0-9_+/-]{32}"),
}

# the same for all rules together; short texts that fail it are left alone at once
_SHORT = 200
_ANY_RULE = (r"(?U)[:=@]|\d[\d .()\t\r\n-]{4,}\d|sk-|-----BEGIN |AKIA|ASIA|gh[pousr]_|github_pat_|xox|AIza|eyJ|"
             r"/home/|/Users/|(?i:bearer)|[A-Za-z0-9_+/-]{32}")


def _plainly_clean(text: Column) -> Column:
    return (F.length(text) <= _SHORT) & ~text.rlike(_ANY_RULE)


class _Rule:
    """One step: when it can apply at all (a cheap test), what it does, how often."""

    def __init__(self, kind: str, pattern: str, flags: str, anchors: Iterable[str]):
        self.kind = kind
        self.pattern = java_pattern(pattern, flags)
        self.anchors = list(anchors)
        self.shown = f"$1{placeholder(kind)}" if kind == _KEEPS_NAME else placeholder(kind)

    def possible(self, piece: Column) -> Column:
        if self.kind in _TESTS:
            return _TESTS[self.kind](piece)
        if not self.anchors:
            return F.lit(True)
        test = F.contains(piece, F.lit(self.anchors[0]))
        for anchor in self.anchors[1:]:
            test = test | F.contains(piece, F.lit(anchor))
        return test

    def apply(self, piece: Column) -> Column:
        return F.when(self.possible(piece), F.regexp_replace(piece, self.pattern, self.shown)).otherwise(piece)

    def count(self, piece: Column) -> Column:
        return F.when(self.possible(piece), F.regexp_count(piece, F.lit(self.pattern))).otherwise(F.lit(0))


class _Cards(_Rule):
    def __init__(self):
        super().__init__(fixed.CARD_KIND, fixed.CARD_PATTERN, "", [])

    def possible(self, piece: Column) -> Column:
        return piece.rlike(r"(?U)\d(?:[ \t\r\n-]?\d){12}")

    def apply(self, piece: Column) -> Column:
        return F.when(self.possible(piece), _cards(piece)).otherwise(piece)

    def count(self, piece: Column) -> Column:
        return F.when(self.possible(piece), _card_count(piece)).otherwise(F.lit(0))


def _personal_rules() -> list[_Rule]:
    return [_Cards(), _Rule(fixed.PHONE_KIND, fixed.PHONE_PATTERN, "", [])]


def _credential_rules() -> list[_Rule]:
    return [_Rule(*rule) for rule in fixed.CREDENTIAL_RULES]


def _run_text(pieces: Column, rules: list[_Rule]) -> Column:
    for rule in rules:
        pieces = F.transform(pieces, rule.apply)
    return pieces


def _run_counted(pieces: Column, rules: list[_Rule]) -> Column:
    """``array<struct<text, hits array<int>>>``: each rule appends how often it matched.

    A rule always changes what it matches, so only texts that changed are searched again to count.
    """

    def step(rule: _Rule):
        def apply(before: Column) -> Column:
            return once(rule.apply(before.text), lambda after: F.struct(
                after.alias("text"), F.array_append(before.hits, F.when(
                    after == before.text, F.lit(0)).otherwise(rule.count(before.text))).alias("hits")))
        return apply

    state = F.transform(pieces, lambda p: F.struct(p.alias("text"), F.array().cast("array<int>").alias("hits")))
    for rule in rules:
        state = F.transform(state, step(rule))
    return state


def _rejoin(pieces: Column, between: Column) -> Column:
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def _protected(text: Column, work) -> Column:
    """Apply ``work(pieces, placeholders)`` to the text cut at the placeholders it already has."""
    pieces = F.split(text, fixed.PLACEHOLDER_PATTERN, -1)
    kept = F.regexp_extract_all(text, F.lit(fixed.PLACEHOLDER_PATTERN), F.lit(0))
    return work(pieces, kept)


def redact(text: Column) -> Column:
    """Credential rules only."""
    return once(text, lambda t: F.when(_plainly_clean(t), t).otherwise(
        _protected(t, lambda p, kept: _rejoin(_run_text(p, _credential_rules()), kept))))


def scrub(text: Column) -> Column:
    """Cards, phones and credentials."""
    return once(text, lambda t: F.when(_plainly_clean(t), t).otherwise(
        redact(F.element_at(_run_text(F.array(t), _personal_rules()), 1))))


def _hit_map(hits: Column, rules: list[_Rule]) -> Column:
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.map_filter(F.map_from_arrays(kinds, hits), lambda _, n: n > 0)


def _total(state: Column, rules: list[_Rule]) -> Column:
    """Hits of every rule over all pieces."""
    zeros = F.array(*[F.lit(0) for _ in rules])
    return F.aggregate(state, zeros, lambda acc, s: F.zip_with(acc, s.hits, lambda a, b: a + b))


def redact_counted(text: Column) -> Column:
    """``struct<text, counts map<string,int>>`` for the credential rules."""
    rules = _credential_rules()

    def finish(pieces: Column, kept: Column) -> Column:
        return once(_run_counted(pieces, rules), lambda state: F.struct(
            _rejoin(F.transform(state, lambda s: s.text), kept).alias("text"),
            _hit_map(_total(state, rules), rules).alias("counts")))

    return once(text, lambda t: _protected(t, finish))


def scrub_counted(text: Column) -> Column:
    """``struct<text, counts map<string,int>>`` for all rules."""
    rules = _personal_rules()

    def finish(first: Column) -> Column:
        return once(redact_counted(first.text), lambda second: F.struct(
            second.text.alias("text"),
            F.map_concat(_hit_map(first.hits, rules), second.counts).alias("counts")))

    return once(F.element_at(_run_counted(F.array(text), rules), 1), finish)


def scrub_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: scrub(F.col(c)) for c in columns})


def hits(counts: Column) -> Column:
    """All hits in a counts map."""
    return F.aggregate(F.map_values(counts), F.lit(0), lambda acc, n: acc + n)

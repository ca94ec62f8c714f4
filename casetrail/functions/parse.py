"""Column functions for the edge: timestamps and statuses as exports spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail import fixed_values as fixed
from casetrail.functions.text import once, strip

_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
_EXTENDED = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[^\d](\d{{2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?)?{_ZONE})?$"
_BASIC = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[^\d](\d{{2}})(?:(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?)?{_ZONE})?$"
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?$"
_PLAIN_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"
_LAST_SECOND = 253_402_300_799  # end of year 9999


def _iso(text: Column, pattern: str) -> Column:
    def part(i: int, default: str) -> Column:
        found = F.regexp_extract(text, pattern, i)
        return F.when(found != "", found).otherwise(default)

    micros = F.rpad(F.substring(part(7, "0"), 1, 6), 6, "0")
    zone = F.regexp_replace(F.regexp_replace(part(8, "+00:00"), "^Z$", "+00:00"), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    spelled = F.concat(part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "), part(4, "00"),
                       F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("."), micros, zone)
    return F.try_to_timestamp(spelled)


def parse_timestamp(raw: Column) -> Column:
    """Epoch seconds or ISO 8601 text as a timestamp; without an offset it is UTC. NULL when it is neither.

    Only full, explicit spellings are taken: Spark's own cast would read ``08:30`` as today and ``1d`` as 1. The
    common spellings are left to that cast once their form has been checked, the others are put together by part.
    """
    def read(text: Column) -> Column:
        number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
        epoch = once(number, lambda n: F.when(n.between(-62_135_596_800, _LAST_SECOND), F.timestamp_micros(
            F.round(n * 1_000_000).cast("long"))))
        return (F.when(text.rlike(_PLAIN), F.concat(text, F.lit("Z")).try_cast("timestamp"))
                .when(text.rlike(_PLAIN_ZONED), text.try_cast("timestamp"))
                .when(text.rlike(_NUMBER), epoch)
                .when(text.rlike(_EXTENDED), _iso(text, _EXTENDED))
                .when(text.rlike(_BASIC), _iso(text, _BASIC)))

    return once(strip(raw), read)


def canonical_activity(raw: Column) -> Column:
    """The field-service activity a raw status stands for; an unknown status stays as it is, without outer blanks."""
    def known(trimmed: Column) -> Column:
        key = F.lower(trimmed)
        cases = None
        for activity in dict.fromkeys(fixed.STATUS_SYNONYMS.values()):
            statuses = [status for status, meant in fixed.STATUS_SYNONYMS.items() if meant == activity]
            cases = (F if cases is None else cases).when(key.isin(statuses), activity)
        return cases.otherwise(trimmed)

    return once(strip(raw), known)

"""Detector packs: a name for each set of detectors that runs on a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from casetrail import fixed_values as fixed
from casetrail.operators import field_service, generic
from casetrail.operators.mining import EventLog, log_facts
from casetrail.session import stash


def run_generic(log: EventLog, factor: float = fixed.BOTTLENECK_FACTOR) -> DataFrame:
    return generic.detect(stash(log_facts(log), ["kind"]), factor)


def run_field_service(log: EventLog, factor: float = fixed.BOTTLENECK_FACTOR) -> DataFrame:
    return field_service.detect(stash(log_facts(log, field_service.JobMeasures()), ["kind"]), factor)


PACKS: dict[str, Callable[..., DataFrame]] = {"quote-to-cash": run_generic, "field-service": run_field_service}


def add_pack(name: str, detect: Callable[..., DataFrame]) -> None:
    """Make another set of detectors available; ``detect(log)`` returns detections."""
    PACKS[name] = detect


def run_pack(name: str, log: EventLog, **options) -> DataFrame:
    return PACKS[name](log, **options)

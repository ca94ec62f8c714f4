"""Exact order statistics without one task that sorts.

The range in which the wanted rank lies is cut into bins, the bins are counted in parallel, and the bin with the rank is cut again. Every
round leaves about a thousandth of the range; a bin of few values is fetched, one of equal values needs no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1_024
FETCHED = 10_000
"""Values that the driver sorts at most."""


def _value_at(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value with ``rank`` others before it, of ``values`` (``v``, finite, all within ``low`` and ``high``)."""
    inside = F.lit(True)
    while low / 2 < high / 2:
        # halves, because the whole range may be beyond a double
        place = F.floor((F.col("v") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) * F.lit(BINS))
        binned = values.where(inside).groupBy(F.least(place, F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for part in binned.orderBy("bin").collect():
            if rank < part.n:
                break
            rank -= part.n
        low, high = part.low, part.high
        inside = (F.col("v") >= low) & (F.col("v") <= high)
        if part.n <= FETCHED:
            return sorted(r.v for r in values.where(inside).collect())[rank]
    return low


def median(values: DataFrame, column: str) -> float | None:
    """The exact median of the finite values, the mean of the two in the middle for an even number of them; nothing without values."""
    kept = values.select(F.col(column).cast("double").alias("v")).where("abs(v) < double('infinity')")
    few = kept.limit(FETCHED + 1).collect()
    if len(few) <= FETCHED:
        found = sorted(r.v for r in few)
        return (found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2 if found else None
    whole = kept.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    lower = _value_at(kept, (whole.n - 1) // 2, whole.low, whole.high)
    if whole.n % 2:
        return lower
    # the next one is the same value again, or the least beyond it
    after = kept.agg(F.count_if(F.col("v") <= lower).alias("n"), F.min(F.when(F.col("v") > lower, F.col("v"))).alias("next")).first()
    upper = lower if after.n > whole.n // 2 else after.next
    return (lower + upper) / 2


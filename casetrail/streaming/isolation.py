"""Work on many items in which some may fail: the others are finished, the failing ones are named with their error.

Spark stops a whole job when one row raises. The job is then run again over two halves of the items, by a hash of their key, each half
that fails is halved again, until a single key is left. ``k`` failing keys among ``n`` cost about ``2 k log2(n)`` small jobs,
and nothing when all goes well. More than ``most`` failing keys mean that the work itself is broken, which is raised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILURES = "id string, stage string, error string"
ERROR_CHARS = 200
DEEPEST = 60


def described(error: Exception) -> str:
    """The kind of an error and the first line of what it says."""
    said = str(error).strip().split("\n", 1)[0]
    return f"{type(error).__name__}: {said}"[:ERROR_CHARS]


def isolated(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, stage: str,
             most: int = 100) -> tuple[DataFrame | None, DataFrame]:
    """``work(items)`` for all items whose key does not make it fail, stored under ``path``, and the failures ``id, stage, error``.

    ``items`` are stored rows. ``work`` gives the same rows for a key whatever other keys are there. A part that runs again replaces
    what it wrote. Without any part that works there is no result.
    """
    spark = items.sparkSession
    place = F.xxhash64(F.col(key).cast("string"))
    todo, done, failed = [(0, 0)], [], []
    while todo:
        depth, remainder = todo.pop()
        part = items.where(place.bitwiseAND(F.lit((1 << depth) - 1)) == remainder) if depth else items
        target = f"{path}/{depth}-{remainder}"
        try:
            work(part).write.mode("overwrite").parquet(target)
            done.append(target)
        except Exception as error:  # whatever the work raises belongs to some item of the part
            keys = [r[0] for r in part.select(F.col(key).cast("string")).distinct().limit(2).collect()]
            if len(keys) > 1 and depth < DEEPEST:
                todo += [(depth + 1, remainder), (depth + 1, remainder + (1 << depth))]
                continue
            failed += [(name, stage, described(error)) for name in keys]
            if len(failed) > most:
                raise
    result = spark.read.parquet(*done) if done else None
    return result, spark.createDataFrame(failed, FAILURES)

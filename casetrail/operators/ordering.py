"""Order-dependent columns over groups of any size.

Spark puts a whole window partition into one task. That is right for ordinary groups, but one case (a default case
id, a system account) can hold a large part of the log. Such groups are *long*: they are cut into ordered pieces of
similar size, each piece is windowed on its own, and the pieces are joined up through their first and last rows.
The results are the same rows and values as one big window would give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.session import broadcast_if_small, stash

LONG_GROUP_ROWS = "casetrail.longGroupRows"
DEFAULT_LONG_GROUP_ROWS = 1_000_000
MOST_LONG_GROUPS = 50_000
TASK_ROWS = "casetrail.taskRows"
DEFAULT_TASK_ROWS = 250_000


def long_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LONG_GROUP_ROWS, str(DEFAULT_LONG_GROUP_ROWS)))


def long_groups(df: DataFrame, key: str, stored: bool = False) -> list:
    """Keys of the groups that should not go through one task: those above the configured row count.

    Only the sizes are computed (one column, combined map-side), and not even those for a stored table with fewer rows
    than that, which its footers tell. At most 50,000 keys come back: if more groups are
    above the count, the bar is raised, and the groups left under it each hold less than 1/50,000 of all rows.
    """
    if stored and df.count() <= long_group_rows(df):
        return []
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > long_group_rows(df))
    largest = sizes.orderBy(F.desc("_rows")).limit(MOST_LONG_GROUPS + 1).collect()
    if len(largest) > MOST_LONG_GROUPS:
        bar = largest[-1]["_rows"]
        largest = [row for row in largest if row["_rows"] > bar]
    return [row[key] for row in largest]


def dealt(df: DataFrame, key: str, most_rows: int) -> DataFrame:
    """Deal at most ``most_rows`` rows by ``key`` to so many tasks that one gets some 250,000 of them.

    The size of a task that Spark chooses is one of compressed bytes, which says little of the rows that sorts and sums hold at once. Short
    inputs are left to Spark, which deals them to all cores.
    """
    spark = df.sparkSession
    tasks = -(-most_rows // int(spark.conf.get(TASK_ROWS, str(DEFAULT_TASK_ROWS))))
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, key) if tasks > usual else df


class Grouped:
    """Rows of one DataFrame, told apart by whether their group is long.

    ``long_keys`` may be given when the caller can count the groups more cheaply than by counting ``rows``. Without
    long groups, the usual case, the plan is the plain one over all rows.
    """

    def __init__(self, rows: DataFrame, key: str, long_keys: list | None = None):
        self.rows = rows
        self.key = key
        if long_keys is not None:
            self.long_keys = long_keys

    @cached_property
    def long_keys(self) -> list:
        return long_groups(self.rows, self.key)

    def _keys(self) -> DataFrame:
        schema = T.StructType([self.rows.schema[self.key]])
        return F.broadcast(self.rows.sparkSession.createDataFrame([(k,) for k in self.long_keys], schema))

    def each(self, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        """``work(rows, is_long)`` on ordinary and on long groups, united. Every group is whole in one of the two."""
        if not self.long_keys:
            return work(self.rows, False)
        ordinary = self.rows.join(self._keys(), self.key, "left_anti")
        long = self.rows.join(self._keys(), self.key, "left_semi")
        return work(ordinary, False).unionByName(work(long, True))


def _pieces(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Cut into ordered pieces by sampled range boundaries; ``_piece`` rises with (key, order)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key, *order).withColumn("_piece", F.spark_partition_id())


def _piece_ends(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Mark the first and last row of every piece and give them a lane of their own (-1)."""
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    marked = df.withColumns({
        "_piece_first": F.lag(F.lit(1)).over(within).isNull(),
        "_piece_last": F.lead(F.lit(1)).over(within).isNull(),
    })
    return marked.withColumn("_lane", F.when(F.col("_piece_first") | F.col("_piece_last"), F.lit(-1)).otherwise(F.col("_piece")))


def numbered(df: DataFrame, order: Sequence[str | Column], new: str) -> DataFrame:
    """Add the 1-based position of every row in the order of all rows.

    The rows are cut into ranges by sampled boundaries and numbered range by range; a table with a row per range tells
    how many come before. No task holds more than a range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stash(df.repartitionByRange(ranges, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_earlier"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(*order))
    return (pieces.withColumn("_at", within).join(F.broadcast(earlier), "_piece")
            .withColumn(new, F.col("_earlier") + F.col("_at")).drop("_piece", "_at", "_earlier"))


def with_next(df: DataFrame, key: str, order: Sequence[str], nexts: dict[str, str], is_long: bool) -> DataFrame:
    """Add the following row's value of some columns: ``nexts`` maps new name -> column."""
    if not is_long:
        window = Window.partitionBy(key).orderBy(*order)
        return df.withColumns({new: F.lead(c).over(window) for new, c in nexts.items()})
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    pieces = _pieces(df, key, order).withColumns({new: F.lead(c).over(within) for new, c in nexts.items()})
    ends = _piece_ends(pieces, key, order)
    across = Window.partitionBy(key, "_lane").orderBy(*order)
    joined = {new: F.when(F.col("_piece_last"), F.lead(c).over(across)).otherwise(F.col(new)) for new, c in nexts.items()}
    return ends.withColumns(joined).drop("_piece", "_piece_first", "_piece_last", "_lane")


def with_position(df: DataFrame, key: str, order: Sequence[str | Column], new: str, is_long: bool) -> DataFrame:
    """Add the 1-based position of every row in its group."""
    if not is_long:
        window = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(new, F.row_number().over(window).cast("long"))
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    ends = _piece_ends(_pieces(df, key, order).withColumn("_at", F.row_number().over(within).cast("long")), key, order)
    before = Window.partitionBy(key, "_lane").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    piece = Window.partitionBy(key, "_piece")
    earlier = F.coalesce(F.sum(F.when(F.col("_piece_last"), F.col("_at")).otherwise(0)).over(before), F.lit(0))
    placed = ends.withColumn("_earlier", F.when(F.col("_lane") == -1, earlier))
    placed = placed.withColumn(new, F.col("_at") + F.max("_earlier").over(piece))
    return placed.drop("_piece", "_piece_first", "_piece_last", "_lane", "_at", "_earlier")


def with_running_max(df: DataFrame, key: str, order: Sequence[str | Column], value: str, new: str,
                     is_long: bool) -> DataFrame:
    """Add the largest ``value`` up to and including each row of its group."""
    if not is_long:
        window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(new, F.max(value).over(window))
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    inside = F.max(value).over(within.rowsBetween(Window.unboundedPreceding, 0))
    ends = _piece_ends(_pieces(df, key, order).withColumn("_inside", inside), key, order)
    before = Window.partitionBy(key, "_lane").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max(F.when(F.col("_piece_last"), F.col("_inside"))).over(before)
    carried = ends.withColumn("_earlier", F.when(F.col("_lane") == -1, earlier))
    reached = F.greatest("_inside", F.max("_earlier").over(Window.partitionBy(key, "_piece")))
    return carried.withColumn(new, reached).drop(
        "_piece", "_piece_first", "_piece_last", "_lane", "_inside", "_earlier")


def with_running_sum(df: DataFrame, key: str, order: Sequence[str | Column], value: str, new: str, is_long: bool) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row of its group, 0 for the first."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not is_long:
        return df.withColumn(new, F.coalesce(F.sum(value).over(before), F.lit(0)))
    within = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(df, key, order).withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    pieces = stash(pieces)
    sums = pieces.groupBy(key, "_piece").agg(F.sum(value).alias("_sum"))
    past = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each piece of each long group
    earlier = sums.select(key, "_piece", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_earlier"))
    joined = pieces.join(broadcast_if_small(earlier), [key, "_piece"])
    return joined.withColumn(new, F.col("_earlier") + F.col("_inside")).drop("_piece", "_inside", "_earlier")


def marked(text: Column) -> Column:
    """A text with its length before it, NULL as ``-``: texts in a row then say where each begins and ends."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def order_free_digest(*parts: Column, only: Column | None = None) -> list[Column]:
    """Aggregates that together identify a set of rows, whatever the order they are added in.

    Each row's SHA-256 is cut into four 32-bit numbers that are summed, so equal sets of rows get equal values, groups
    combine map-side and no group is ever collected. Include the position for sequences. ``only`` leaves rows out.
    """
    digest = F.sha2(F.concat(*[marked(p.cast("string")) for p in parts]), 256)
    slices = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return [F.sum(s if only is None else F.when(only, s)).alias(f"_digest{i}") for i, s in enumerate(slices)]


def digest_text(rows: Column) -> Column:
    """The digest columns as one string, prefixed by the row count."""
    return F.concat_ws("-", rows.cast("string"), *[F.lower(F.hex(F.col(f"_digest{i}"))) for i in range(4)])

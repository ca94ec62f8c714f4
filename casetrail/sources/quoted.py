"""Records of quoted text files (CSV) whose cells may span lines, found in blocks.

Whether a line begins inside a quoted cell depends on all lines before it. What a line does to that is a function of two states, so the
functions of the lines of a block make one of the block, blocks are composed in order, and every line learns its state from its own block
and the state the block begins in. A file is read and cut in as many tasks as it has blocks; only lines of files
that have such cells are shuffled, by block, and only the lines of a record that spans lines meet.

A cell is quoted when a quote is its first character; it ends at a quote that is not doubled, what then follows up to the next
comma or line belongs to it. Lines end with a line feed, with or without a carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casetrail.functions.rows import computed
from casetrail.session import broadcast_if_small, stash
from casetrail.sources.files import BLOCK, FILE, ORIGIN, place_in_file

PLACE = "_place_in"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_LEFT_OPEN = rf"\A{_CELLS}{_QUOTED}\z"
_UP_TO_CLOSE = r'\A[^"]*+(?:""[^"]*+)*+"'


def opens(line: Column) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    return line.contains('"') & line.rlike(_LEFT_OPEN)


def stays_open(line: Column) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one."""
    rest = F.regexp_replace(line, _UP_TO_CLOSE + "[^,]*+", "")
    reopened = rest.startswith(",") & opens(F.substr(rest, F.lit(2)))
    return ~line.contains('"') | ~line.rlike(_UP_TO_CLOSE) | reopened


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` with the file, block and place of every line."""
    read = spark.read.option("lineSep", "\n").text(path).select("value", *[F.expr(e) for e in ORIGIN])
    return read.withColumn(PLACE, place_in_file())


def files(lines: DataFrame) -> DataFrame:
    """Per file: its first line that is not blank, and whether a cell of it may span lines. One pass over the text."""
    first = F.min(F.when(F.trim(F.regexp_replace("value", "\r$", "")) != "", F.col(PLACE)))
    return stash(lines.groupBy(FILE).agg(first.alias("_first"), F.max(opens(F.col("value"))).alias("_spanning")))


def _after(begin: Column, mark: Column, swaps: Column) -> Column:
    """The state after some steps that began in ``begin``: that of the last step that fixes it (``mark``), changed by the swaps since."""
    odd = F.when(mark.isNull(), swaps).otherwise(swaps - mark.getField("swaps")) % 2 == 1
    return F.coalesce(mark.getField("state"), begin) != odd


def _with_state(steps: DataFrame, keys: list[str], order: str, if_out: str, if_in: str) -> DataFrame:
    """Add ``_mark`` and ``_swaps``, what the steps before each step in its group do, for :func:`_after`."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fixed, swap = F.col(if_out) == F.col(if_in), F.col(if_out) & ~F.col(if_in)
    counted = steps.withColumn("_swaps", F.coalesce(F.sum(swap.cast("long")).over(before), F.lit(0)))
    own = F.when(fixed, F.struct(F.col(if_out).alias("state"), F.col("_swaps").alias("swaps")))
    return counted.withColumn("_mark", F.last(own, ignorenulls=True).over(before))


def records(lines: DataFrame) -> DataFrame:
    """``value`` (the text of a record), its file, block and place, from the lines of files with cells that span lines."""
    steps = lines.withColumns({"_out": opens(F.col("value")), "_in": stays_open(F.col("value"))})
    steps = _with_state(steps, [FILE, BLOCK], PLACE, "_out", "_in")
    mark, swaps = F.col("_mark"), F.col("_swaps")
    out, inside = F.lit(False), F.lit(True)
    upto = Window.partitionBy(FILE, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    named = {}
    for name, begin in (("out", out), ("in", inside)):  # for both states the block may begin in
        state = _after(begin, mark, swaps)
        named |= {f"_begins_{name}": state, f"_ends_{name}": F.when(state, F.col("_in")).otherwise(F.col("_out"))}
    steps = steps.withColumns(named)
    steps = stash(steps.select(
        "value", FILE, BLOCK, PLACE, "_ends_out", "_ends_in", "_begins_out", "_begins_in",
        *[F.last(F.when(~F.col(f"_begins_{name}"), F.col(PLACE)), ignorenulls=True).over(upto).alias(f"_start_{name}")
          for name in ("out", "in")]))

    last = [F.max_by(c, PLACE).alias(c) for c in ("_ends_out", "_ends_in", "_start_out", "_start_in")]
    blocks = steps.groupBy(FILE, BLOCK).agg(*last)
    blocks = _with_state(blocks, [FILE], BLOCK, "_ends_out", "_ends_in")
    blocks = blocks.withColumn("_begins", _after(out, F.col("_mark"), F.col("_swaps")))
    start = F.when(F.col("_begins"), F.col("_start_in")).otherwise(F.col("_start_out"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(FILE, BLOCK, "_begins", F.last(start, ignorenulls=True).over(earlier).alias("_carried"))

    chosen = {c: F.when(F.col("_begins"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out")) for c in ("_ends", "_start")}
    chosen["_start"] = F.coalesce(chosen["_start"], "_carried")
    placed = steps.join(broadcast_if_small(blocks), [FILE, BLOCK]).select("value", FILE, BLOCK, PLACE, *[v.alias(c) for c, v in chosen.items()])
    alone = ~F.col("_ends") & (F.col("_start") == F.col(PLACE))
    parts = F.array_sort(F.collect_list(F.struct(PLACE, "value")))
    joined = placed.where(~alone).groupBy(FILE, F.col("_start").alias(PLACE)).agg(
        F.array_join(parts.getField("value"), "\n").alias("value"), F.min(BLOCK).alias(BLOCK))
    return placed.where(alone).select("value", FILE, BLOCK, PLACE).unionByName(joined)


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header: a struct ``cells`` of all columns as text, with file, block and place of every record.

    Spark's own parser reads the records. The first file's header names the columns of all; the first line of every file that is not blank is left out.
    """
    names = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).columns
    schema = ", ".join("`{}` string".format(name.replace("`", "``")) for name in names)
    lines = read_lines(spark, path)
    known = files(lines)
    spanning = lines.join(broadcast_if_small(known.where("_spanning").select(FILE)), FILE, "left_semi")
    plain = lines.join(broadcast_if_small(known.where("not _spanning").select(FILE)), FILE, "left_semi")
    found = plain
    if not known.where("_spanning").isEmpty():
        found = plain.unionByName(records(spanning))
    found = found.join(broadcast_if_small(known.select(FILE, "_first")), FILE).where(F.col(PLACE) > F.col("_first"))
    text = F.regexp_replace("value", "\r$", "")
    cells = F.from_csv(text, schema, {"escape": '"', "multiLine": "true"})
    return computed(found.where(F.trim(text) != ""), [FILE, BLOCK, PLACE], F.struct(cells.alias("cells")))

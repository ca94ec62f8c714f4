"""Where a row came from and in which place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casetrail.session import broadcast_if_small, stash

FILE, BLOCK = "_file", "_block"
ORIGIN = [f"_metadata.file_path as {FILE}", f"_metadata.file_block_start as {BLOCK}"]
COUNTER_BITS = 33


def place_in_file() -> Column:
    """A number that rises with the position of a row in its file, for rows just read (no shuffle in between).

    A file is read in blocks. Every row takes at least a byte, so block start plus row count grows from block to block;
    a partition that holds several blocks only holds last blocks of files, behind which nothing follows.
    """
    return F.col(BLOCK) + F.monotonically_increasing_id().bitwiseAND((1 << COUNTER_BITS) - 1)


def file_offsets(spark: SparkSession, path: str | list[str], recursive: bool = False, names: str | None = None) -> DataFrame:
    """``_file, _offset``: added to places in the files, offsets make numbers that rise by file name and place.

    The files are listed as a table (without their content) and cut into ranges by name, so neither the driver nor one
    task has to hold them all. Up to 2^30 files have room; more stop with an overflow.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    read = read.option("pathGlobFilter", names) if names else read
    room = F.col("length") + F.lit(1 << COUNTER_BITS)
    listed = read.load(path).select(F.col("_metadata.file_path").alias(FILE), room.alias("_room"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = stash(listed.repartitionByRange(ranges, FILE).withColumn("_piece", F.spark_partition_id()))
    sums = pieces.groupBy("_piece").agg(F.sum("_room").alias("_sum"))
    past = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("_piece", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_earlier"))
    own = Window.partitionBy("_piece").orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_room").over(own), F.lit(0))
    return (pieces.withColumn("_inside", inside).join(F.broadcast(earlier), "_piece")
            .select(FILE, (F.col("_earlier") + F.col("_inside")).alias("_offset")))


def with_ingest_seq(rows: DataFrame, place: Column, offsets: DataFrame, new: str = "ingest_seq") -> DataFrame:
    """Add ``ingest_seq``, unique and rising by file name and ``place``. A row of an unlisted file stops the read."""
    placed = rows.withColumn("_place", place.cast("long")).join(broadcast_if_small(offsets), FILE, "left")
    unknown = F.raise_error(F.concat(F.lit("a file without an offset: "), FILE)).cast("long")
    return placed.withColumn(new, F.coalesce("_offset", unknown) + F.col("_place")).drop("_offset", "_place")

"""Rows kept whole under one column, places of rows, hot keys and folds: what the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.session import broadcast_if_small, stash

HOT_SHARE = 0.001
"""A key is hot when it holds more than this share of the rows, so at most 1,000 keys are hot at any size."""

SMALL_ROWS = 200_000
"""Tables of narrow rows (a few numbers each) are broadcast up to this many rows, counted before."""


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(rows: DataFrame, **needed: Column) -> DataFrame:
    """``rows`` with all given columns in the struct ``row`` and only ``needed`` beside it, so no names can clash."""
    return rows.select(F.struct(*[col(c) for c in rows.columns]).alias("row"),
                       *[value.alias(name) for name, value in needed.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def _straight(rows: DataFrame) -> bool:
    """Whether every row of ``rows`` is one row of a file: a scan with at most projections and filters above it."""
    node, names = rows._jdf.queryExecution().analyzed(), set()
    while node.children().size() == 1:
        names.add(node.nodeName())
        node = node.children().apply(0)
    return names <= {"Project", "Filter", "SubqueryAlias"} and node.children().isEmpty() and bool(rows.inputFiles())


def anchored(rows: DataFrame) -> DataFrame:
    """``rows`` if they come straight from files, else a copy in the shared folder: rows that keep their places.

    Call it once where several ``placed`` tables of one input have to agree.
    """
    if _straight(rows) and "_metadata" not in [c.lower() for c in rows.columns]:
        try:
            rows.select("_metadata.row_index")
            return rows
        except AnalysisException:  # a source without row numbers
            pass
    return stash(packed(rows)).select("row.*")


def placed(rows: DataFrame, **needed: Column) -> DataFrame:
    """``packed`` with ``file`` and ``pos``, the file and the row in it: a name for a row that stays the same in later jobs.

    ``rows`` are ``anchored``.
    """
    meta = {"file": F.col("_metadata.file_path"), "pos": F.col("_metadata.row_index")}
    return packed(rows, **needed, **meta)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``placed`` rows but for those at the places in ``dropped`` (``file``, ``pos``).

    A short list is sent to the rows; a longer one is joined by place, a key that no two rows share.
    """
    gone = broadcast_if_small(dropped.select("file", "pos"), SMALL_ROWS)
    return rows.join(gone, ["file", "pos"], "left_anti")


def join_counted(rows: DataFrame, values: DataFrame, key: str, n: str = "n", how: str = "left") -> DataFrame:
    """Join ``rows`` with ``values`` (one row per key, with the number ``n`` of rows that have it), hot keys included.

    Values of hot keys are at most ``1 / HOT_SHARE`` and are sent to the rows, which then need not meet in one task; the
    other keys are joined by key. The result is that of a plain join; ``rows`` should be a landed table, it is read twice.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    least = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(values.where(F.col(n) > least))
    few = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col(n) <= least), key, how)
    return few.unionByName(rest)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 2_000) -> Callable:
    """``work`` for ``mapInArrow`` on batches of at most ``rows`` rows; a worker that is done gives its buffers back, because it
    stays for other tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()

    return run


def fold(doc_id: str, parts: int) -> Column:
    """The remainder that assigns a document to training or to held-out rows. A null id is in no fold."""
    return F.crc32(col(doc_id).cast("string")) % parts


def held_out(doc_id: str, parts: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))

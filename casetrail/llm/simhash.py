"""SimHash near duplicates: exact search for close fingerprints with vantage-point trees.

Equal fingerprints are one point. The bits are cut into ``bands`` parts; two fingerprints that differ in at most
``distance`` bits differ in at most ``distance // bands`` bits of one part at least. For every part there is a
vantage-point tree over the Hamming distance of that part, grown on a bounded sample: a node sends a point to the side
its distance to the vantage point says, and also to the other side where the triangle bound cannot rule out a partner
there (a boundary-overlapping shard). With more parts than bits of distance (5 for 4) the bound is zero, so no shard
overlaps; a tree over all 64 bits would send two thirds of the points to both sides of every node, because distances of
unrelated fingerprints all lie near 32. Within a shard all 64 bits are compared. The search is exact for any tree.

A shard holds ``leaf`` points about; a shard beyond ``tile`` points is cut into tiles and every two tiles are compared in
a task of their own, so memory is bounded by two tiles whatever the data. A task gives a spanning star per group of
linked points, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.components import components
from casetrail.llm.rows import anchored, col, join_counted, lean, placed, unpacked, without
from casetrail.session import stash

WIDTH = 4
DISTANCE = 4
SEED = 42
SAMPLE = 20_000
"""Fingerprints the trees are grown on. The sample decides where shards end, not which pairs are found."""
DEEPEST = 14
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of the word shingles of a text in UTF-8; 0 without words.

    Only A-Z are lower-cased and only ASCII white space parts words, which is what ``bytes`` does.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(words))
    digest, shingles = xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(64, np.int64)
    starts, stops = (ends - lengths)[:shingles].tolist(), ends[width - 1:].tolist()
    for at in range(0, shingles, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _BLOCK], stops[at:at + _BLOCK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > shingles, bitorder="little").tobytes(), "little")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(rows: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``rows`` (narrow columns and ``text``) with ``fp``, the fingerprint as a signed long, in place of the text."""
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept, F.lit(0).cast("long").alias("fp")).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            found = _signed([fingerprint(value.as_py(), width) for value in texts])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)], [*kept, "fp"])

    return rows.select(*kept, text).mapInArrow(lean(hashed), schema)


class Tree:
    """A vantage-point tree over the bits in ``mask``: node ``i`` has the children ``2i + 1`` (near) and ``2i + 2``."""

    def __init__(self, points: np.ndarray, mask: int, depth: int, radius: int):
        self.mask, self.depth, self.radius = np.uint64(mask), depth, radius
        self.vantage = np.zeros(2 ** depth - 1, np.uint64)
        self.within = np.full(2 ** depth - 1, 64, np.int64)  # without a split all points are near
        held = {0: points & self.mask}
        for node in range(len(self.vantage)):
            here = held.pop(node, points[:0])
            if len(here):
                self.vantage[node], self.within[node] = self._split(here)
                near = self._distance(here, node) <= self.within[node]
                held[2 * node + 1], held[2 * node + 2] = here[near], here[~near]

    @staticmethod
    def _split(here: np.ndarray) -> tuple[np.uint64, int]:
        """The vantage point and radius, of a few points of the sample, that part the points most evenly."""
        best = (len(here), here[0], 64)
        for candidate in here[:: max(1, len(here) // 16)][:16]:
            sums = np.cumsum(np.bincount(np.bitwise_count(here ^ candidate), minlength=65))
            at = int(np.argmin(np.abs(2 * sums - len(here))))
            best = min(best, (abs(int(2 * sums[at]) - len(here)), candidate, at), key=lambda x: x[0])
        return best[1], best[2] if best[0] < len(here) else 64

    def _distance(self, points: np.ndarray, node: int) -> np.ndarray:
        return np.bitwise_count((points ^ self.vantage[node]) & self.mask).astype(np.int64)

    def shards(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the indices of the points that belong or may have a partner there."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node >= len(self.vantage):
                yield node, at
                continue
            far = self._distance(points[at], node) - self.within[node]
            todo.append((2 * node + 1, at[far <= self.radius]))
            todo.append((2 * node + 2, at[far > -self.radius]))


def grow(sample: np.ndarray, n: int, leaf: int, bands: int, distance: int = DISTANCE) -> list[Tree]:
    cuts = [64 * b // bands for b in range(bands + 1)]
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, n) / leaf))))
    return [Tree(sample, (1 << high) - (1 << low), depth, distance // bands) for low, high in zip(cuts, cuts[1:])]


def stars(points: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Groups of points that links of at most ``distance`` bits hold together, as (centre, member) without the centre.

    Every point is compared with those that no group has yet, so a dense group costs no more than a loose one.
    """
    centres, members = [], []
    left = points
    while len(left) > 1:
        centre, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            linked = np.bitwise_count(left ^ queue.pop()) <= distance
            if linked.any():
                found = left[linked]
                left = left[~linked]
                queue.extend(found)
                members.append(found)
                centres.append(np.full(len(found), centre))
    none = points[:0]
    return np.concatenate([none, *centres]), np.concatenate([none, *members])


def links(points: DataFrame, distance: int = DISTANCE, bands: int | None = None, leaf: int = 2_000,
          tile: int = 20_000) -> DataFrame:
    """``u``, ``v`` that hold together all of ``points`` (``fp``, distinct, landed) within ``distance`` bits of each other.

    Every given edge joins members of one group, and every two points within the distance are in one group; all pairs
    are not listed.
    """
    bands = bands or distance + 1
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(1_000_000)) < round(share * 1_000_000)).limit(2 * SAMPLE)
    trees = grow(np.sort(np.array([r.fp for r in chosen.collect()], np.int64)).view(np.uint64), n, leaf, bands, distance)
    named = points.sparkSession.sparkContext.broadcast(trees)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy().view(np.uint64)
            rows = [(b, shard, len(at)) for b, tree in enumerate(named.value) for shard, at in tree.shards(values)]
            yield pd.DataFrame(rows, columns=["band", "shard", "n"])

    # at most bands * 2^DEEPEST shards exist, whatever the input
    sizes = (points.mapInPandas(counted, "band int, shard int, n long").groupBy("band", "shard")
             .agg(F.sum("n").alias("n")).where(F.col("n") > tile).collect())
    tiles = {(r.band, r.shard): math.ceil(r.n / tile) for r in sizes}

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy().view(np.uint64)
            for band, tree in enumerate(named.value):
                for shard, at in tree.shards(values):
                    k = tiles.get((band, shard), 1)
                    own = (values[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k
                    for other in range(k):
                        yield pd.DataFrame({"band": np.int32(band), "shard": np.int32(shard),
                                            "a": np.minimum(own, other).astype(np.int32),
                                            "b": np.maximum(own, other).astype(np.int32),
                                            "fp": values[at].view(np.int64)})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One frame for a batch instead of one for each shard."""
        for batch in batches:
            found = list(routed(iter([batch])))
            if found:
                yield pd.concat(found, ignore_index=True)

    def linked(shard: pd.DataFrame) -> pd.DataFrame:
        centre, member = stars(shard["fp"].to_numpy().view(np.uint64), distance)
        return pd.DataFrame({"u": centre.view(np.int64), "v": member.view(np.int64)})

    shards = points.mapInPandas(gathered, "band int, shard int, a int, b int, fp long")
    return shards.groupBy("band", "shard", "a", "b").applyInPandas(linked, "u long, v long")


def groups(prints: DataFrame, order: list[str], distance: int = DISTANCE, **how) -> DataFrame:
    """For every fingerprint in ``prints`` (landed; ``fp`` and the ``order`` columns): ``fp``, ``n`` rows that have it,
    ``component`` and ``first``, the least ``order`` columns of the rows in its component."""
    first = F.min(F.struct(*order)).alias("first")
    points = stash(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first))
    held = components(links(points.select("fp"), distance, **how))
    points = points.join(held.withColumnRenamed("node", "fp"), "fp", "left")
    points = stash(points.withColumn("component", F.coalesce("component", "fp")))
    least = points.groupBy("component").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    met = join_counted(points.select("fp", F.col("n").alias("copies"), "component"), stash(least), "component", how="inner")
    return met.select("fp", F.col("copies").alias("n"), "component", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    distance: int = DISTANCE, **how) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the least id that links
    reach), ``copies`` (documents with the same fingerprint), and its place (``file``, ``pos``) with that of the document
    that stays (``keep_file``, ``keep_pos``).

    Null and empty texts and texts of white space have fingerprint 0 and are linked like any other. A null id counts as
    greater than any other; a component of null ids only has a null ``component_id``. Of rows with equal ids the first by
    place stays. An empty table gives no rows. Other columns are not looked at.
    """
    rows = placed(anchored(docs), doc_id=col(doc_id), body=col(text)).select("file", "pos", "doc_id", "body")
    prints = stash(fingerprints(rows.withColumn("no_id", F.col("doc_id").isNull()), "body", width))
    found = stash(groups(prints, ["no_id", "doc_id", "file", "pos"], distance, **how))
    return join_counted(prints, found, "fp", how="inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"),
        F.col("n").alias("copies"), "file", "pos", F.col("first.file").alias("keep_file"),
        F.col("first.pos").alias("keep_pos"))


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: the one with the least id."""
    docs = anchored(docs)
    found = stash(near_duplicates(docs, **how))
    dropped = found.where("file <> keep_file or pos <> keep_pos")
    return unpacked(without(placed(docs), dropped))

"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors of one label are compared. A vector of length one at distance ``r`` from another falls into the same cell of a Gaussian
projection cut into steps of ``STEP`` with a probability that only ``r`` decides. A table joins the cells of several projections into one
bucket, so that unrelated vectors seldom meet, and there are so many tables that a pair at the cosine asked for is
missed in all of them with a probability of ``MISSED`` at most; closer pairs are missed less often. Both numbers follow
from how many different vectors the largest label has, counted first.

Equal vectors of one label are one point with a number of copies. Only buckets with two points or more go on: their points get
their vectors, and a task computes the cosines of a bucket as a matrix product. A bucket beyond ``TILE`` points is cut into tiles and
every two tiles are compared in a task of their own. A pair that meets in several tables counts in the first of them:
the task works the hashes of the earlier tables out again from the vectors. What leaves a task is a number of links per point
and a spanning star per group of linked points, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.components import components
from casetrail.llm.rows import col, join_counted, lean
from casetrail.session import spread, stash

COSINE = 0.98
STEP = 2.0
MISSED = 1e-6
UNRELATED = math.sqrt(2)
"""Distance of unrelated vectors (at a right angle)."""
STRAY = 0.05
"""Unrelated points that a point meets in a table, on average."""
TILE = 1_024
SEED = 11
_PAIRS = 1 << 20


def collision(distance: float, step: float = STEP) -> float:
    """Probability that two points at this distance fall into one cell of a Gaussian projection cut into steps."""
    if distance <= 0:
        return 1.0
    s = step / distance
    below = 0.5 * math.erfc(s / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


@dataclass(frozen=True)
class Tables:
    """``tables`` hash tables of ``width`` projections each."""

    tables: int
    width: int
    step: float = STEP
    seed: int = SEED

    @classmethod
    def planned(cls, points: int, cosine: float, missed: float = MISSED, step: float = STEP) -> Tables:
        width = max(1, math.ceil(math.log(max(2, points) / STRAY) / -math.log(collision(UNRELATED, step))))
        found = collision(math.sqrt(max(0.0, 2 - 2 * cosine)), step) ** width
        return cls(max(1, math.ceil(math.log(missed) / math.log1p(-found))) if found < 1 else 1, width, step)

    def hashes(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit hash per vector (row) and table (column) of the cells that the vector is in."""
        directions, offsets, odd = _drawn(self, unit.shape[1])
        cells = np.floor((unit @ directions + offsets) / self.step).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(unit), self.tables, self.width)
        mixed = np.zeros(cells.shape[:2], np.uint64)
        for k in range(self.width):
            mixed = (mixed ^ cells[:, :, k]) * odd[k]
            mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64)


@cache
def _drawn(tables: Tables, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng([tables.seed, tables.tables, tables.width, dimension])
    directions = draw.standard_normal((dimension, tables.tables * tables.width))
    offsets = draw.uniform(0, tables.step, tables.tables * tables.width)
    return directions, offsets, draw.integers(0, 1 << 63, tables.width, np.uint64) * np.uint64(2) + np.uint64(1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector's doubles as bytes, null for a vector that links with nothing."""
    for batch in batches:
        lists = batch.column("vector")
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # a negative zero is a zero
        gone, labels = lists.is_null().to_numpy(zero_copy_only=False), batch.column("label").is_null().to_numpy(zero_copy_only=False)
        found = []
        for i, (start, stop) in enumerate(zip(ends[:-1], ends[1:])):
            own = flat[start:stop]
            size = np.linalg.norm(own)
            usable = not gone[i] and not labels[i] and 0 < size < np.inf
            found.append(own.tobytes() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(found, pa.binary())],
                                         ["vec_id", "label", "data"])


def _unit(data: pa.Array, dimension: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(data.to_pylist()), "<f8").reshape(-1, dimension)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _by_dimension(data: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(v) // 8 for v in data.to_pylist()], np.int64)
    for dimension in np.unique(sizes):
        yield int(dimension), np.flatnonzero(sizes == dimension)


def bucketed(points: DataFrame, tables: Tables) -> DataFrame:
    """``bucket`` (a hash of table, label, dimension and cells), ``point``: a row per point and table."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dimension, at in _by_dimension(batch.column("data")):
                own = batch.take(pa.array(at))
                hashes = tables.hashes(_unit(own.column("data"), dimension))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own.column("point").to_numpy(), tables.tables)),
                     pa.array(np.repeat(own.column("salt").to_numpy(), tables.tables)),
                     pa.array(np.tile(np.arange(tables.tables, dtype=np.int32), len(at))),
                     pa.array(hashes.ravel())], ["point", "salt", "nth", "cells"])

    salted = points.select("point", "data", F.xxhash64("label", F.length("data")).alias("salt"))
    rows = salted.mapInArrow(lean(work), "point long, salt long, nth int, cells long")
    return rows.select(F.xxhash64("nth", "salt", "cells").alias("bucket"), "nth", "point")


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and member of every group of points that ``near`` (a symmetric matrix) holds together."""
    left, centres, members = near.any(axis=1), [], []
    while left.any():
        centre = int(left.argmax())
        left[centre] = False
        queue = np.array([centre])
        while len(queue):
            queue = np.flatnonzero(near[queue].any(axis=0) & left)
            left[queue] = False
            centres.append(np.full(len(queue), centre))
            members.append(queue)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *centres]), np.concatenate([none, *members])


class _Bucket:
    """Links between the points of a bucket, or of two tiles of one, that no earlier table shows."""

    def __init__(self, tables: Tables, cosine: float):
        self.tables, self.cosine = tables, cosine

    def _new(self, hashes: np.ndarray, nth: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs share no bucket of an earlier table."""
        new = np.ones(len(i), bool)
        for at in range(0, len(i), _PAIRS):
            part = slice(at, at + _PAIRS)
            for earlier in range(nth):
                new[part] &= hashes[i[part], earlier] != hashes[j[part], earlier]
        return new

    def links(self, unit: np.ndarray, nth: int, tile: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions. With ``own`` all points are of one tile, else only pairs of different tiles count."""
        near = unit @ unit.T >= self.cosine
        i, j = np.nonzero(np.triu(near, 1))
        if not own:
            other = tile[i] != tile[j]
            i, j = i[other], j[other]
        if nth and len(i):
            used = np.unique(np.concatenate([i, j]))
            hashes = np.zeros((len(unit), self.tables.tables), np.int64)
            hashes[used] = self.tables.hashes(unit[used])
            new = self._new(hashes, nth, i, j)
            i, j = i[new], j[new]
        return i, j


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (``bucket``, ``a``, ``b``) of rows that come in this order, of some thousand rows each."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> int:
        """Where the last group of the rows begins."""
        keys = [rows.column(c).to_numpy() for c in ("bucket", "a", "b")]
        changed = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        return int(changed[-1]) + 1 if len(changed) else 0

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 4 * TILE:
            rows = pa.Table.from_batches(held)
            at = cut(rows)
            if at:
                yield rows.slice(0, at).combine_chunks()
                held = rows.slice(at).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def linked(shards: DataFrame, tables: Tables, cosine: float) -> DataFrame:
    """``u``, ``v`` with ``links`` 0 (star edges), and ``u`` with its number of ``links``, from ``shards``: ``bucket``, ``nth``, ``a``, ``b``,
    ``tile``, ``point``, ``copies``, ``label``, ``data``, sorted within tasks that hold whole groups."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(tables, cosine)
        for rows in _grouped(batches):
            keys = [rows.column(c).to_numpy() for c in ("bucket", "a", "b")]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            points, copies, nth, tiles = (rows.column(c).to_numpy() for c in ("point", "copies", "nth", "tile"))
            data = rows.column("data").combine_chunks()
            labels = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            out_point, out_links, out_u, out_v = [], [], [], []
            for start, stop in zip(starts, [*starts[1:], len(points)]):
                held = data.slice(start, stop - start)
                own = bool(keys[1][start] == keys[2][start])
                # of a hash shared by buckets of different tables, labels or dimensions, each part alone
                sizes = np.array([len(v) for v in held.to_pylist()], np.int64)
                kinds = np.stack([sizes, nth[start:stop], labels[start:stop]], axis=1)
                for kind in np.unique(kinds, axis=0):
                    at = np.flatnonzero((kinds == kind).all(axis=1))
                    if len(at) < 2:
                        continue
                    unit = _unit(held.take(pa.array(at)), int(kind[0]) // 8)
                    at += start
                    i, j = bucket.links(unit, int(kind[1]), tiles[at], own)
                    if not len(i):
                        continue
                    sums = (np.bincount(i, copies[at][j], len(at)) + np.bincount(j, copies[at][i], len(at))).astype(np.int64)
                    some = sums > 0
                    out_point.append(points[at][some])
                    out_links.append(sums[some])
                    near = np.zeros((len(at), len(at)), bool)
                    near[i, j] = near[j, i] = True
                    centre, member = _stars(near)
                    out_u.append(points[at][centre])
                    out_v.append(points[at][member])
            if out_point:
                point, links, u, v = (np.concatenate(part) for part in (out_point, out_links, out_u, out_v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([u, point])), pa.array(np.concatenate([v, np.zeros_like(point)])),
                     pa.array(np.concatenate([np.zeros_like(u), links]))], ["u", "v", "links"])

    return shards.select("bucket", "nth", "a", "b", "tile", "point", "copies", "label", "data").mapInArrow(work, "u long, v long, links long")


def links(points: DataFrame, cosine: float = COSINE, tables: Tables | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """From ``points`` (landed; ``point`` long, ``label``, ``data``, ``copies``) the edges ``u``, ``v`` that hold linked points together, and
    ``point``, ``links``: the copies of all points that a point is linked with."""
    most = points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tables = tables or Tables.planned(most, cosine)
    members = stash(bucketed(points, tables))
    shared = stash(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = join_counted(members, shared, "bucket", how="inner")
    parts = F.ceil(F.col("n") / tile).cast("int")
    met = met.withColumn("parts", parts).withColumn("tile", F.pmod(F.xxhash64(F.lit(SEED), "point"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("bucket", "nth", "point", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    shards = met.join(points.select("point", "label", "data", "copies"), "point")
    shards = shards.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = stash(linked(shards, tables, cosine))
    counts = found.where("links > 0").groupBy(F.col("u").alias("point")).agg(F.sum("links").alias("links"))
    return found.where("links = 0").select("u", "v"), counts


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, **how) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other rows with a vector of the same label at this cosine or more),
    ``component_id`` (the least id that links reach) and ``kept`` (whether it is the row's own).

    Vectors that are null, empty, zero, hold null, NaN or infinite entries, or have no label link with nothing, and vectors of
    different lengths do not link. Repeated rows are linked copies. A null id counts as greater than any other: a component
    of null ids only has a null ``component_id``, and its rows are kept. Of rows with one id all are kept or none. An empty
    table gives no rows. Other columns are not looked at.
    """
    named = spread(rows.select(col(vec_id).alias("vec_id"), col(label).alias("label"),
                               col(vector).cast("array<double>").alias("vector")))
    kinds = {c: named.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    packed = named.mapInArrow(lean(_packed), f"vec_id {kinds['vec_id']}, label {kinds['label']}, data binary")
    packed = stash(packed.withColumn("key", F.when(F.col("data").isNotNull(), F.sha2(F.concat(
        F.to_json(F.struct("label")).cast("binary"), "data"), 256))))
    alone = packed.where("data is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")).alias("first")
    points = (packed.where("data is not null").groupBy("key")
              .agg(F.count(F.lit(1)).alias("copies"), first, F.any_value("label").alias("label"), F.any_value("data").alias("data")))
    points = stash(points.withColumn("point", F.monotonically_increasing_id()))
    edges, counts = links(points, cosine, **how)
    held = components(edges)
    found = (points.select("key", "point", "copies", "first").join(held.withColumnRenamed("node", "point"), "point", "left")
             .join(counts, "point", "left"))
    found = stash(found.select("key", "copies", "first", F.coalesce("component", "point").alias("component"),
                               (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = found.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    answer = join_counted(found, stash(least), "component", how="inner").select(
        "key", F.col("copies").alias("n"), "n_links", F.col("least.vec_id").alias("component_id"))
    met = join_counted(packed.where("data is not null").select("vec_id", "key"), stash(answer), "key", how="inner")
    return (met.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))

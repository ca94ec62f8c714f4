"""Embedding whitening with distributed block matrices of Spark MLlib.

Every vector becomes whole numbers; the centred rows are indexed into a BlockMatrix. Its transpose times itself gives the scatter
matrix, whose eigenvectors are found in the driver (one number per pair of dimensions), and the BlockMatrix times the whitening
matrix projects the rows. The rows stay in blocks of a bounded number of rows. The product over the long side is cut into
parts that are summed block by block, because a plain product would bring all blocks of a one-block result to one task.

A row's index names a place in the blocks: the rows of a task start at a block of their own, so no row has to be counted
before another. Places without a row are zeros after centring and add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm.rows import col, lean
from casetrail.session import spread, stash

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
BLOCK = 1_024
"""Rows and columns of a block, at least; see ``block_rows``."""
MOST_BLOCKS = 1_000_000
_LARGEST = 2.0 ** 52
_LOW = 24
_LONG = 1 << 63


def whole_numbers(vector: Column) -> Column:
    """The vector as whole numbers, null where the vector or an entry is null, not finite, or 2^52 or more in size."""
    entries = vector.cast("array<double>")
    good = F.forall(entries, lambda e: e.isNotNull() & (F.abs(e) < _LARGEST))
    return F.when(good, F.transform(entries, lambda e: F.floor(e * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long")))


def block_rows(n: int) -> int:
    """Rows of a block: the names of all blocks are known to the driver, so blocks grow where there are very many rows."""
    return max(BLOCK, -(-n // MOST_BLOCKS))


@dataclass(frozen=True)
class Fit:
    """What the fit list says: its rows, their sums by dimension, the trace of the covariance, and its leading eigenvectors (columns) by
    falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def landed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``x`` and ``part``, ``nth`` (task and row in it) of the rows that can be used, in the shared folder.

    Rows whose vector is not of the commonest length (of several, the longest) are left out too.
    """
    numbers = spread(rows.select(col(vec_id).alias("vec_id"), col(vector).alias("vector")))
    place = F.monotonically_increasing_id()
    numbers = stash(numbers.select("vec_id", whole_numbers(F.col("vector")).alias("x")).where("x is not null")
                    .select("vec_id", "x", F.size("x").alias("d"), F.shiftright(place, 33).cast("long").alias("part"),
                            place.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    common = numbers.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return numbers.where(F.col("d") == (common.d if common else 0))


def sums(numbers: DataFrame) -> tuple[int, ...]:
    """The exact sum of every dimension; high and low bits are summed apart."""
    each = numbers.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(
        F.sum(F.shiftright("x", _LOW)).alias("high"), F.sum(F.col("x").bitwiseAND(F.lit((1 << _LOW) - 1))).alias("low"))
    return tuple((r.high << _LOW) + r.low for r in each.orderBy("at").collect())


def _centred(n: int, totals: tuple[int, ...], stride: int):
    """Batches of ``part``, ``nth``, ``x`` as ``index``, ``centred`` and ``deviation``, the latter null beyond a long."""
    d = len(totals)
    narrow = max([abs(s) for s in totals], default=0) < 1 << 61

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if narrow and n * int(np.abs(x).max(initial=0)) < 1 << 61:
                moved = x * n - np.array(totals, np.int64)
            else:
                moved = x.astype(object) * n - np.array(totals, object)
            centred = (moved / n).astype(np.float64)
            size = int(np.abs(moved).max(initial=0))
            if size * size * d < _LONG:
                own = moved.astype(np.int64)
                deviation = pa.array((own * own).sum(axis=1))
            else:  # beyond 64 bits in between
                exact = ((row * row).sum() for row in moved.astype(object))
                deviation = pa.array([v if v < _LONG else None for v in exact], pa.int64())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d)
            index = batch.column("part").to_numpy() * stride + batch.column("nth").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(index), pa.ListArray.from_arrays(offsets, pa.array(centred.ravel())), deviation],
                ["vec_id", "index", "centred", "deviation"])

    return lean(work)


def centred(numbers: DataFrame, n: int, totals: tuple[int, ...], rows_of_block: int) -> DataFrame:
    """``vec_id``, ``index``, ``centred`` (array of doubles), ``deviation``."""
    most = numbers.agg(F.max("nth")).first()[0]
    stride = (most // rows_of_block + 1) * rows_of_block
    kind = numbers.schema["vec_id"].dataType.simpleString()
    return numbers.select("vec_id", "x", "part", "nth").mapInArrow(
        _centred(n, totals, stride), f"vec_id {kind}, index long, centred array<double>, deviation long")


def blocks(rows: DataFrame, rows_of_block: int, columns_of_block: int) -> BlockMatrix:
    """``index`` and ``centred`` as a BlockMatrix."""
    vectors = rows.select("index", array_to_vector("centred").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(rows_of_block, columns_of_block)


def scatter(matrix: BlockMatrix, parts: int) -> np.ndarray:
    """The transpose times the matrix. The long side is cut into ``parts``, each summed in tasks of its own."""
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and unit eigenvectors; of either sign the one whose largest entry is positive. Dimensions without
    variance give none."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > max(values.max(initial=0), 0) * 1e-12
    values, vectors = values[real], vectors[:, real]
    largest = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, int)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def projected(spark: SparkSession, matrix: BlockMatrix, by: np.ndarray) -> DataFrame:
    """``index`` and ``whitened`` (array): the matrix times ``by``, one row per index."""
    side = matrix.colsPerBlock
    pieces = [((k, 0), Matrices.dense(len(cut), by.shape[1], cut.ravel(order="F")))
              for k, cut in enumerate(by[at:at + side] for at in range(0, len(by), side))]
    small = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), side, by.shape[1])
    found = matrix.multiply(small).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", found._java_matrix_wrapper._java_model).select(
        "index", vector_to_array("vector").alias("whitened"))


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest difference between the covariance of ``whitened`` (``k`` entries) and the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return 0.0
    each = F.col("whitened")
    found = rows.agg(*[F.covar_pop(each[i], each[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """The fit over all usable rows, and ``vec_id``, ``deviation``, ``whitened`` (an array, one entry per component) of each."""
    spark = rows.sparkSession
    numbers = landed(rows, vec_id, vector)
    n = numbers.count()
    totals = sums(numbers) if n else ()
    if not totals:
        kind = numbers.schema["vec_id"].dataType.simpleString()
        none = spark.createDataFrame([], f"vec_id {kind}, deviation long, whitened array<double>")
        return Fit(n, (), 0.0, np.zeros(0), np.zeros((0, 0))), none
    rows_of_block = block_rows(n)
    moved = centred(numbers, n, totals, rows_of_block)
    matrix = blocks(moved, rows_of_block, min(len(totals), BLOCK))
    covariance = scatter(matrix, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))) / n
    values, vectors = eigen(covariance, most)
    fit = Fit(n, totals, float(np.trace(covariance)), values, vectors)
    kept = moved.select("vec_id", "index", "deviation")
    if not len(values):
        return fit, kept.select("vec_id", "deviation", F.array().cast("array<double>").alias("whitened"))
    found = kept.join(projected(spark, matrix, fit.matrix), "index").drop("index")
    return fit, stash(found)


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: ``vec_id``, ``component`` (from 1, by falling variance), ``n`` (rows of the fit),
    ``deviation`` (the exact sum over dimensions of ``(n * x - sum)`` squared; null where it needs more than 64 bits),
    ``whitened``, ``explained`` (the component's share of the variance) and ``identity_error`` of the whole result.

    Rows whose vector is null or holds null, NaN, infinite entries or ones of 2^52 or more are left out, and those whose
    vector is not of the commonest length (of several, the longest). Repeated rows and null ids count like any other. There
    are at most ``most`` components, none for directions without variance: equal vectors only, empty vectors and an empty
    table give no rows. Components of equal variance come in any order. Other columns are not looked at.
    """
    fit, found = whiten(rows, vec_id, vector, most)
    error = identity_error(found, len(fit.values))
    share = F.array(*[F.lit(v) for v in fit.explained]).cast("array<double>")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained") if fit.explained else F.lit(None).cast("double").alias("explained"),
        F.lit(error).alias("identity_error"))

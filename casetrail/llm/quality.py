"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text become a short vector. Cosines of random projections of the standardised vector approximate
a Gaussian kernel, so ridge regression on them is a kernel machine with a fixed number of weights. Its normal equations
are sums over documents: each task sums its own, Spark adds the sums, the driver solves one small system. The training
fold that the regression did not see gives the isotonic calibration, by pooling adjacent violators over bins of scores.

All labelled documents of the training folds are used; what reaches the driver does not depend on their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.rows import col, fold, lean
from casetrail.session import stash

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
COSINES = 192
RIDGE = 1e-3
SEED = 20_26
GOOD = 0.7
BINS = 2_000
"""Bins of raw scores between -1 and 2; scores beyond count in the outer bins."""
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _COMMON, _SYMBOL = range(7)

STATISTICS = ["log_chars", "log_words", "word_length", "word_spread", "long_words", "short_words", "capitalised", "upper", "digits",
              "common_marks", "symbols", "spaces", "marked_words", "double_marks", "number_words", "distinct_words", "top_word",
              "distinct_lines", "line_length", "ended_lines", "sentence_length", "same_neighbours", "distinct_pairs", "entropy"]


@cache
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, _SYMBOL, np.int8)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            kinds[p] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            kinds[p] = _DIGIT
        elif c == "\n":
            kinds[p] = _LINE
        elif c.isspace():
            kinds[p] = _SPACE
    kinds[[ord(c) for c in ".,;:!?'\"()-"]] = _COMMON
    return kinds


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a whole text; zeros for a text that is null or has no words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    n, w = len(kinds), len(words)
    share = np.bincount(kinds, minlength=7) / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    mark = (kinds == _SYMBOL) | (kinds == _COMMON)
    counts = Counter(words)
    often = np.fromiter(counts.values(), np.float64, len(counts)) / w
    lines = [line for line in text.split("\n") if line.strip()]
    ends = sum(text.count(c) for c in ".!?")
    starts = [x[0] for x in words]
    last = [x[-1] for x in words]
    return [
        np.log1p(n), np.log1p(w), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()),
        float((lengths <= 3).mean()), sum(map(str.isupper, starts)) / w, float(share[_UPPER]), float(share[_DIGIT]),
        float(share[_COMMON]), float(share[_SYMBOL]), float(share[_SPACE] + share[_LINE]),
        sum(not c.isalnum() for c in last) / w, float((mark[1:] & mark[:-1]).mean()) if n > 1 else 0.0,
        sum(map(str.isdigit, starts)) / w, len(counts) / w, float(often.max()), len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))), sum(line.rstrip()[-1] in ".!?" for line in lines) / len(lines),
        float(np.log1p(w / (ends + 1))), sum(a == b for a, b in zip(words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / w, float(-(often * np.log(often)).sum() / np.log(w + 1)),
    ]


def features(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``x``, the statistics, in place of the text."""
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept, F.lit(None).cast("array<double>").alias("x")).schema

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(value.as_py()) for value in batch.column(text)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], x], [*kept, "x"])

    return rows.select(*kept, text).mapInArrow(lean(measured), schema)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    """Raw scores between which the calibrated ones are interpolated."""
    share: np.ndarray

    @staticmethod
    def directions(width: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return rng.normal(size=(width, COSINES)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, COSINES)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w, b = self.directions(x.shape[1])
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.share), 0.0, 1.0)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["x"].tolist(), np.float64).reshape(len(frame), -1)


def _summed(rows: DataFrame, of, most: int) -> dict[tuple[int, int], float]:
    """The sum over all rows of a small matrix of sums that each task makes: entries by row and column."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                part = of(frame)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).limit(most)
    return {(r.i, r.j): r.v for r in sums.collect()}


def isotonic(values: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres of the pooled blocks of sorted ``values`` and their shares of good rows."""
    blocks: list[list[float]] = []
    for v, g, k in zip(values, good, n):
        blocks.append([v * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def train(labelled: DataFrame) -> Classifier | None:
    """A classifier from ``x``, ``y`` (0 to 1) and ``calibration`` (which rows calibrate); None without training rows.

    ``labelled`` should be a landed table: three passes go over it.
    """
    fit, rest = labelled.where("not calibration"), labelled.where("calibration")
    width = len(STATISTICS)

    def moments(frame: pd.DataFrame) -> np.ndarray:
        x = _matrix(frame)
        return np.vstack([np.full(width, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])

    sums = _summed(fit, moments, 3 * width)
    if not sums:
        return None
    n, s, ss = (np.array([sums[i, j] for j in range(width)]) for i in range(3))
    mean = s / n
    scale = np.sqrt(np.maximum(ss / n - mean * mean, 0))
    found = Classifier(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(COSINES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal(frame: pd.DataFrame) -> np.ndarray:
        z = found.cosines(_matrix(frame))
        return z.T @ np.hstack([z, frame["y"].to_numpy(np.float64)[:, None]])

    size = COSINES + 1
    sums = _summed(fit, normal, size * (size + 1))
    a = np.array([[sums[i, j] for j in range(size + 1)] for i in range(size)])
    penalty = RIDGE * n[0] * np.diag([1.0] * COSINES + [0.0]) / COSINES
    found.weights = np.linalg.solve(a[:, :size] + penalty + 1e-9 * np.eye(size), a[:, size])

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = np.clip(found.raw_scores(_matrix(frame)), -1, 2)
            yield pd.DataFrame({"bin": np.minimum((raw + 1) / 3 * BINS, BINS - 1).astype(np.int32), "raw": raw,
                                "y": frame["y"].to_numpy(np.float64)})

    bins = (rest.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin")
            .agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
    if bins:
        found.raw, found.share = isotonic(*(np.array([r[c] for r in bins], np.float64) for c in ("raw", "y", "n")))
    return found


def score(rows: DataFrame, found: Classifier | None) -> DataFrame:
    """``rows`` with ``score`` in place of ``x``; 0.5 without a classifier."""
    kept = [c for c in rows.columns if c != "x"]
    if found is None:
        return rows.select(*kept, F.lit(0.5).alias("score"))
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[kept].assign(score=sent.value.scores(_matrix(frame)) if len(frame) else 0.0)

    return rows.mapInPandas(scored, rows.select(*kept, F.lit(0.0).alias("score")).schema)


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1, the calibrated share of good documents) and
    ``predicted`` (1 from ``GOOD`` on).

    A null, empty or blank text has all statistics 0 and is scored like any other. Documents with a null id have no label and
    are in no fold. A document with several labels counts with their mean; null labels count as none. Without labels every
    score is 0.5. Rows that are repeated are each scored. Other columns are not looked at.
    """
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    # a copy of the id goes through Python: pandas would make floats of ids that have nulls
    landed = stash(features(rows.withColumn("id", F.col("doc_id").cast("string")).drop("doc_id"), "text"))
    part = fold("id", FOLDS)
    marks = (labels.select(col(doc_id).cast("string").alias("id"), col(label).cast("double").alias("y"))
             .where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y")))
    labelled = stash(landed.where(part != HELD_OUT).join(marks, "id")
                     .select("x", "y", (fold("id", FOLDS) == CALIBRATION).alias("calibration")))
    scored = score(landed, train(labelled))
    return scored.select(
        F.col("id").cast("long").alias("doc_id"), F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"))

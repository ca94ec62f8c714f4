import random

import numpy as np
from pyspark.sql import functions as F

from casetrail.llm import quality as Q
from casetrail.llm.rows import fold


def corpus(n):
    rng = random.Random(8)
    words = ["river", "stone", "over", "the", "of", "and", "walks", "seldom", "bright", "morning"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if good:
            text = ". ".join(" ".join(body[k:k + 8]).capitalize() for k in range(0, len(body), 8)) + "."
        else:
            text = rng.choice(["$$$ ", "### "]).join(body) if rng.random() < 0.5 else "BUY NOW!! " * len(body)
        rows.append((i, text))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_rows_and_odd_texts(spark):
    rows, labels = corpus(900)
    odd = [(5000, None), (5001, ""), (5002, " \n "), (5003, "x" * 40000), (None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("y", F.lit(1)).withColumn("quality", F.lit(0))
    marks = spark.createDataFrame(labels + [(1, None), (None, 1), (9999, 0), labels[0]], "doc_id long, quality int").withColumn("doc", F.lit(1))
    found = Q.quality(docs, marks).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    by = {r.doc_id: r for r in found}
    truth = dict(labels)
    held = [i for i in truth if by[i].held_out]
    assert len(held) > 100
    assert {r.doc_id for r in docs.where(fold("doc_id", 4) == 2).collect()} == {r.doc_id for r in found if r.held_out}
    assert np.mean([by[i].predicted == truth[i] for i in held]) > 0.97
    assert len({r.score for r in found if r.doc_id in (None, 0)}) == 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    other = marks.withColumn("quality", F.when(fold("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in Q.quality(docs, m).collect()} for m in (marks, other))
    assert max(abs(one[i] - two[i]) for i in one) < 1e-9


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.quality(docs, marks).collect()] == [0.5, 0.5]
    assert Q.quality(docs.where("false"), marks).count() == 0


def test_isotonic_is_least_squares_among_rising_functions():
    rng = np.random.default_rng(2)
    values, n = np.arange(30.0), rng.integers(1, 5, 30).astype(float)
    good = np.minimum(n, np.maximum(0, np.round(n * np.clip(values / 30 + rng.normal(0, 0.3, 30), 0, 1))))
    centres, shares = Q.isotonic(values, good, n)
    assert (np.diff(shares) > 0).all() and (np.diff(centres) > 0).all()
    # the max-min formula of isotonic regression
    mean = lambda a, b: good[a:b + 1].sum() / n[a:b + 1].sum()
    fit = np.array([max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)])
    assert np.allclose(sorted(set(np.round(fit, 9))), sorted(set(np.round(shares, 9))))


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, len(Q.STATISTICS)))
    found = Q.Classifier(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(1), np.zeros(2), np.zeros(2))
    z = found.cosines(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * x.shape[1]))
    assert np.abs(z @ z.T - exact).max() < 0.4 and np.abs(z @ z.T - exact).mean() < 0.06

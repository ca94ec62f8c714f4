import numpy as np
import pytest

from casetrail.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x int, index string, part int"


def rows(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "y", 2) for i, v in zip(ids, vectors)], SCHEMA)


def expected(vectors):
    """Deviations, eigenvalues and the rows projected on the unit eigenvectors, by falling eigenvalue."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    deviation = [sum(int(v) ** 2 for v in row) for row in (x * n - total).tolist()]
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return deviation, values[::-1], centred @ vectors[:, ::-1]


def matches(found, ids, vectors, most=8):
    deviation, values, turned = expected(vectors)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert {*by} == {*ids}
    k = min(most, sum(values > values[0] * 1e-12))
    assert all(sorted(own) == list(range(1, k + 1)) for own in by.values())
    assert all(by[i][1].deviation == d and by[i][1].n == len(ids) for i, d in zip(ids, deviation))
    for c in range(k):
        got = np.array([by[i][c + 1].whitened for i in ids])
        own = turned[:, c] / np.sqrt(values[c])
        assert np.allclose(got * np.sign(got @ own), own, atol=1e-8)
        assert by[ids[0]][c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in found)


def test_against_numpy_over_many_blocks(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(0, draw.uniform(0.1, 1, 12), (3000, 12))
    matches(whitening.whitened(rows(spark, vectors.tolist()).repartition(3)).collect(), list(range(3000)), vectors)


def test_unusable_rows_and_other_lengths_are_left_out(spark):
    good = np.random.default_rng(2).normal(0, 1, (20, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [2.0 ** 52, 0.0, 0.0], [1.0], []]
    found = whitening.whitened(rows(spark, good + bad)).collect()
    matches(found, list(range(20)), good)


def test_repeated_rows_null_ids_and_large_numbers(spark):
    vectors = [[1e9, 2.0], [1e9, 2.0], [-3e9, 5.0], [7e8, 1.0]]
    found = whitening.whitened(rows(spark, vectors, [1, 1, None, 2])).collect()
    deviation = expected(vectors)[0]
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found if r.component == 1) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert {r.deviation for r in found} == {d if d < 1 << 63 else None for d in deviation} == {None}


def test_no_variance_and_empty_tables(spark):
    assert whitening.whitened(rows(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whitened(rows(spark, [[], []])).collect() == []
    assert whitening.whitened(rows(spark, [])).collect() == []
    one_way = whitening.whitened(rows(spark, [[1.0, 2.0], [2.0, 2.0], [4.0, 2.0]])).collect()
    assert {r.component for r in one_way} == {1} and one_way[0].explained == pytest.approx(1)


def test_query(spark):
    found = queries.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    matches(found, [r.vec_id for r in table], [r.embedding for r in table])

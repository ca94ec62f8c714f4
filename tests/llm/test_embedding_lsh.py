import numpy as np
import pytest

from casetrail.llm import embedding_lsh, queries

SCHEMA = "vec_id long, embedding array<float>, label int, point string, key int, n int"


def rows(spark, found):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, 2)
                                  for i, v, label in found], SCHEMA)


def brute(found, cosine=0.98):
    """Links, components and what is kept by comparing all pairs."""
    vectors = [None if v is None or None in list(v) else np.float32(v).astype(float) for _, v, _ in found]
    usable = [v is not None and label is not None and np.isfinite(v).all() and v.any() for v, (_, _, label) in zip(vectors, found)]
    near = {i: [j for j in range(len(found)) if j != i and usable[i] and usable[j] and found[i][2] == found[j][2]
                and len(vectors[i]) == len(vectors[j])
                and vectors[i] @ vectors[j] >= cosine * np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])] for i in range(len(found))}
    result = []
    for i in near:
        reached, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - reached
            reached |= new
            todo += new
        ids = [found[j][0] for j in reached if found[j][0] is not None]
        least = min(ids, default=None)
        result.append((found[i][0], len(near[i]), least, found[i][0] == least))
    return sorted(result, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(seed=3, dimension=24, spread=0.11):
    draw = np.random.default_rng(seed)
    found = []
    for label in range(3):
        for size in (1, 1, 1, 2, 5, 40):
            centre = draw.normal(size=dimension)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                noise = draw.normal(size=dimension)
                found.append((len(found), (centre + spread * noise / np.linalg.norm(noise)) * draw.uniform(0.1, 9), label))
    return found


def test_against_all_pairs(spark):
    found = clustered()
    expected = brute(found)
    assert any(0 < n < 39 for _, n, _, _ in expected)
    assert result(embedding_lsh.near_duplicates(rows(spark, found))) == expected


def test_tiles_give_the_same(spark, monkeypatch):
    found = clustered(4)
    monkeypatch.setattr(embedding_lsh.links, "__defaults__", (embedding_lsh.COSINE, None, 7))
    assert result(embedding_lsh.near_duplicates(rows(spark, found))) == brute(found)


def test_copies_nulls_zeros_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    found = [(1, [1, 0], 0), (2, [1, 0], 0), (3, [2, 0], 0), (4, [1, 0], 1), (5, [1, 0, 0], 0), (6, [0, 0], 0), (7, [0, 0], 0), (8, None, 0),
             (9, [nan, 1], 0), (10, [inf, 1], 0), (11, [None, 1], 0), (12, [1, 0], None), (13, [1, 0], None), (14, [], 0), (15, [], 0),
             (16, [-0.0, 1], 0), (17, [0.0, 1], 0), (18, [-1, 0], 0), (18, [-1, 0], 0), (None, [0, 5], 0)]
    assert result(embedding_lsh.near_duplicates(rows(spark, found))) == brute(found)


def test_null_ids_only_and_empty_table(spark):
    found = [(None, [1, 0], 0), (None, [1, 0], 0)]
    assert result(embedding_lsh.near_duplicates(rows(spark, found))) == [(None, 1, None, True)] * 2
    assert result(embedding_lsh.near_duplicates(rows(spark, []))) == []


def test_collision_probability_by_drawing():
    draw = np.random.default_rng(5)
    for distance in (0.2, 1.0, 2 ** 0.5):
        at, offset = draw.standard_normal(400_000) * distance, draw.uniform(0, 2, 400_000)
        share = np.mean(np.floor(offset / 2) == np.floor((at + offset) / 2))
        assert embedding_lsh.collision(distance, 2.0) == pytest.approx(share, abs=0.004)


def test_tables_miss_no_more_than_planned():
    for points in (2, 5_000, 10 ** 9):
        tables = embedding_lsh.Tables.planned(points, 0.98)
        assert (1 - embedding_lsh.collision(0.2) ** tables.width) ** tables.tables <= embedding_lsh.MISSED
        assert points * embedding_lsh.collision(2 ** 0.5) ** tables.width <= embedding_lsh.STRAY


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    found = [(r.vec_id, r.embedding, r.label) for r in table]
    assert result(queries.op11_embedding_lsh(spark, "/root/testdata/sf0.001")) == brute(found)

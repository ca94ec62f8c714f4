import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casetrail.llm import simhash
from casetrail.llm.components import components


def print_of(text):
    """The fingerprint by its definition, bit by bit."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reached(prints):
    """Smallest id reachable through links of at most four bits."""
    ids = list(prints)
    best = {i: i for i in ids}
    linked = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= 4] for i in ids}
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        best[i] = min(seen)
    return best


TEXTS = [None, "", " \t\n", "One", "one", "one two three", "One Two three four", "one two three four five six",
         "É été Ünï code words and more words", "é été ünï code words and more words", "a\x0bb\x0cc\x1cd e f g",
         "x " * 3000, "x " * 3001, "same same same same same", "w" * 20000]


def test_fingerprint_follows_its_definition():
    for text in TEXTS:
        assert simhash.fingerprint(text.encode() if text else None) == print_of(text)


def test_rows_of_any_kind(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(3, "One", "x"), (None, "One", "x"), (40, "one two three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component", F.lit(1))
    found = simhash.near_duplicates(docs).collect()
    prints = {i: print_of(t) for i, t, _ in rows if i is not None}
    expected = reached(prints)
    assert sorted((r.doc_id is None, r.doc_id or 0, int(r.fingerprint, 16), r.component_id) for r in found) == sorted(
        [(False, i, prints[i], expected[i]) for i, t, _ in rows if i is not None] + [(True, 0, print_of("one"), 3)])
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_only_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [None, None]
    assert simhash.distinct_documents(docs).count() == 1
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.distinct_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("how", [{}, {"leaf": 8}, {"bands": 2, "leaf": 8}, {"bands": 3, "leaf": 16}, {"bands": 1, "leaf": 30},
                                 {"leaf": 8, "tile": 5}])
def test_trees_and_tiles_lose_no_link(spark, how):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    points = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False))
              for c in centres for _ in range(8)]
    points = {i: p for i, p in enumerate(dict.fromkeys(points))}
    prints = spark.createDataFrame([(i, p) for i, p in points.items()], "doc_id long, fp long")
    found = simhash.groups(prints, ["doc_id"], **how).collect()
    expected = reached(points)
    assert {points[expected[i]] for i in points} == {points[r.first.doc_id] for r in found}
    assert {r.fp: r.first.doc_id for r in found} == {points[i]: expected[i] for i in points}


def test_components_of_a_long_chain_a_hub_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2000, 2300)] + [(2299, 5)]
    rows = chain + hub + [(9, 9), (7, 8), (8, 7), (7, 8), (None, 3), (4, None), (-5, 150)]
    found = {r.node: r.component for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {**{i: -5 for i in [-5, *range(100, 161)]}, **{i: 1 for i in [1, 5, *range(2000, 2300)]},
                     9: 9, 7: 7, 8: 7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from casetrail.llm import exact_dedup

TEXTS = [None, "", "  ", "\t\r\n", " a", "a", "a ", "a  b", "a\x0b\x0cb", "a b", "a\x1cb", "A b", "é b", "a b", "z" * 50000]


def body(text):
    return re.sub("[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    """Groups of (id, text) rows by brute force; ids are unique or null."""
    found = []
    for i, t in rows:
        same = [j for j, u in rows if body(u) == body(t)]
        ids = [j for j in same if j is not None]
        found.append((i, min(ids, default=None), len(same), hashlib.sha256(body(t).encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("key", [exact_dedup.whole, lambda sha: F.substring(F.hex(sha), 1, 1), lambda sha: F.lit("same")])
def test_groups_whatever_the_key(spark, key):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(200 + i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (None, "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    found = exact_dedup.exact_duplicates(docs, key=key).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == expected(rows)
    groups = {r.text_sha256 for r in found}
    assert sorted(r.text_sha256 for r in found if r.kept) == sorted(groups)
    assert all(r.keep_id == r.doc_id for r in found if r.kept)


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a")] * 5 + [(None, "b")] * 3 + [(2, "a")], "doc_id long, text string")
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a"), (None, "b")]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(docs).count() == 0


def test_state_goes_on(spark, tmp_path):
    first = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(4, "a"), (7, "b"), (8, "c")], "doc_id long, text string")
    exact_dedup.exact_duplicates(first, home=str(tmp_path)).count()
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in
             exact_dedup.exact_duplicates(later, home=str(tmp_path)).collect()}
    assert found == {4: (4, 2, True), 7: (6, 2, False), 8: (8, 1, True)}


@pytest.mark.parametrize("key", [exact_dedup.whole, lambda sha: F.substring(F.hex(sha), 1, 1)])
def test_a_short_key_loses_nothing_over_sessions(spark, tmp_path, key):
    sessions = [[(i, f"text {i % 90}") for i in range(100)], [(1_000 + i, f"new {i}") for i in range(300)],
                [(50, "text 7"), (2_000, " text  7"), (2_001, "new 3"), (2_002, "last"), (None, "last")]]
    seen = []
    for rows in sessions:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = exact_dedup.exact_duplicates(docs, home=str(tmp_path), key=key).collect()
        seen += rows
        every = {}
        for i, k, n, sha in expected(seen):
            every.setdefault(sha, (k, n))
        # of equal texts the row with the smallest id stays, whichever session it came in
        assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in found) == sorted(
            (str(i), *every[hashlib.sha256(body(t).encode()).hexdigest()]) for i, t in rows)
        if rows is sessions[1]:
            assert sum(r.kept for r in found) == 300

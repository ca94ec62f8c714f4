import os

import duckdb
import pytest

import __spark_entry__ as entry
from casetrail.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
FULL = {"op1_url_filter": "pages", "op2_quality": "documents", "op5_warc": "pages", "op6_exact_dedup": "documents", "op7_personal_data": "documents",
        "op8_class_lm": "documents", "op9_language_id": "documents", "op10_simhash": "documents",
        "op11_embedding_lsh": "embeddings", "op12_alignment": "documents"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return connection


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    rows = found.collect()
    assert rows
    if name in FULL:
        assert len(rows) == tables.execute(f"SELECT count(*) FROM {FULL[name]}").fetchall()[0][0]
    if name in ORACLE:
        result = tables.execute(ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(found.columns)
        order = [columns.index(c) for c in found.columns]
        assert sorted(map(str, (tuple(r[i] for i in order) for r in result.fetchall()))) == sorted(str(tuple(r)) for r in rows)

import os

import duckdb
import pytest

import __spark_entry__ as entry
from casetrail.plans.inputs import TABLES
from casetrail.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# queries of optional parts have tests of their own beside them
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = entry.queries()[name](spark, DATA)
    rows = found.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    result = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == expected

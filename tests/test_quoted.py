import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from casetrail.sources import exports as X
from casetrail.sources import quoted as Q

COLUMNS = X.ColumnMap("job", "status", "when", resource="note")


@pytest.fixture
def block(spark):
    """Sets how many bytes a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def of(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield of
    for name, value in before.items():
        spark.conf.set(name, value)


def exported(seed, rows, line_end="\n"):
    """A CSV text with cells that span lines, doubled quotes, commas, and quotes inside unquoted cells."""
    draw = random.Random(seed)

    def cell():
        kind = draw.random()
        letters = [*"abc ,", '"', "\n", '",', '\n"', "x" * 9] if kind < 0.4 else [*"abc", 'y"z', "1"]
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 6)))
        if kind < 0.4:
            return '"' + text.replace('"', '""') + '"'
        return "u" + text

    lines = ["job,status,when,note"] + [",".join([f"J{i}", cell(), cell(), cell()]) for i in range(rows)]
    return line_end.join(lines) + line_end


def found(spark, path):
    rows = Q.read_cells(spark, path).select("cells.*", Q.FILE, Q.PLACE).orderBy(Q.FILE, Q.PLACE).collect()
    return [tuple(r)[:4] for r in rows]


@pytest.mark.parametrize("size", [40, 333, 100_000])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_every_block_size_gives_the_rows_of_a_whole_read(spark, tmp_path, block, size, line_end):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(exported(name, 60, line_end), encoding="utf-8", newline="")
    (tmp_path / "c.csv").write_text('job,status,when,note\nJ0,5" pipe,"x",y\n\nJ1,a,b,c\n', encoding="utf-8")
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    expected = [tuple(r) for r in whole.collect()]
    block(size)
    rows = found(spark, str(tmp_path))
    assert sorted(rows, key=str) == sorted(expected, key=str)
    per_file = [int(r[0][1:]) for r in rows]
    assert per_file == [*range(60), *range(60), 0, 1]  # in the order of the files
    parsed = [tuple(r) for name in ("a", "b") for r in list(csv.reader(io.StringIO(exported(name, 60, line_end), newline="")))[1:]]
    assert [tuple(v or "" for v in r) for r in rows[:120]] == parsed


def test_a_file_with_one_spanning_cell_is_read_by_many_tasks(spark, tmp_path, block):
    text = "job,status,when,note\n" + 'J,"two\nlines",1,n\n' + "J,quote,1,n\n" * 3_000
    (tmp_path / "x.csv").write_text(text)
    block(4_000)
    rows = X.read_csv(spark, str(tmp_path), COLUMNS)
    assert Q.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    assert rows.count() == 3_001 and rows.select("ingest_seq").distinct().count() == 3_001
    assert rows.orderBy("ingest_seq").first().activity == "two\nlines"


def test_a_cell_over_many_blocks_and_one_that_never_ends(spark, tmp_path, block):
    long = "\n".join("part" for _ in range(500))
    (tmp_path / "x.csv").write_text(f'job,status,when,note\nJ0,"{long}",1,n\nJ1,a,1,n\nJ2,"open\nJ3,b,1,n\n')
    block(100)
    rows = found(spark, str(tmp_path))
    assert [r[0] for r in rows] == ["J0", "J1", "J2"] and rows[0][1] == long and "J3,b" in rows[2][1]


def test_line_states(spark):
    cases = {'a,"b': (True, False), 'a,"b"': (False, False), 'x': (False, True), 'a"b': (False, False), '"a""': (True, False), '","': (False, True),
             'a","b': (True, True), '"a"b,"c': (True, True), '': (False, True), '""': (False, True), '"""': (True, False), '",': (True, False)}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", Q.opens(F.col("v")), Q.stays_open(F.col("v")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("job,status,when,note\n")
    (tmp_path / "b.csv").write_text("\n\njob,status,when,note\nJ1,a,b\n")
    assert found(spark, str(tmp_path)) == [("J1", "a", "b", None)]

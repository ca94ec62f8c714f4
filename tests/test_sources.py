import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casetrail.functions.parse import canonical_activity, parse_timestamp
from casetrail.operators import mining as M
from casetrail.plans.queries import jsonl_rows
from casetrail.sources import exports as X

COLUMNS = X.ColumnMap("job", "status", "when", resource="note")


def write(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def load(spark, path, columns=COLUMNS, **options):
    events = X.normalise_events(X.read_export(spark, path, columns), columns.source_system, **options)
    return events.orderBy("ingest_seq").collect()


def test_csv_maps_statuses(spark, tmp_path):
    path = write(tmp_path, "x.csv", "job,status,when\nJ1,quote,1700000000\nJ1,quote accepted,1700003600\n"
                                    "J1,on site,1700100000\n")
    events = load(spark, path)
    assert [e.activity for e in events] == ["Quote", "QuoteApproved", "Attended"]
    assert events[0].entity_fqn == "fsm.job.J1" and events[0].ts.timestamp() == 1_700_000_000


def test_hostile_csv(spark, tmp_path):
    secret = "sk-ant-api03-" + "A" * 30
    path = write(tmp_path, "x.csv", f"﻿job,status,when,note\nJ1,quote,1700000000,key {secret}\nJ2,quote,,none\n"
                                    "J3,won,2026-01-15T08:30:00,\"two\nlines, \"\"said\"\"\"\nJ4\n")
    events = load(spark, path)
    assert [e.case_id for e in events] == ["J1", "J3"]
    assert secret not in events[0].resource and events[1].resource == 'two\nlines, "said"'


def test_secrets_in_any_column(spark, tmp_path):
    aws = "AKIA" + "1234567890ABCDEF"
    event, = load(spark, write(tmp_path, "x.csv", f"job,status,when,note\n{aws},quote,1700000000,clean\n"))
    assert aws not in event.case_id + event.activity + event.entity_fqn


def test_hashed_cases_stay_apart(spark, tmp_path):
    path = write(tmp_path, "x.csv", "job,status,when\n1234567,quote,1\n7654321,quote,2\n")
    assert len({e.case_id for e in load(spark, path)}) == 1
    hashed = load(spark, path, case_key="hash", salt="s")
    assert len({e.case_id for e in hashed}) == 2 and "1234567" not in hashed[0].case_id


def test_json_shapes(spark, tmp_path):
    rows = [{"job": "J9", "status": "completed", "when": "2026-01-15T08:30:00+00:00"}, 5,
            {"job": "J8", "status": "x", "when": 1700000000.5, "note": None}]
    for name, document in (("a.json", rows), ("b.json", {"rows": rows})):
        events = load(spark, write(tmp_path, name, json.dumps(document)))
        assert [(e.case_id, e.activity) for e in events] == [("J9", "JobComplete"), ("J8", "x")]
        assert events[1].ts.timestamp() == 1_700_000_000.5


@pytest.mark.parametrize("document", ["42", '{"a": 1}', '"x"', "[1, 2"])
def test_other_json_is_refused(spark, tmp_path, document):
    with pytest.raises(Exception, match="JSON export must be a list"):
        load(spark, write(tmp_path, "x.json", document))


def test_malformed_time_stops_the_load_or_is_set_aside(spark, tmp_path):
    path = write(tmp_path, "x.csv", "job,status,when\nJ1,quote,1700000000\nJ2,quote,08:30\n,quote,bad\n")
    with pytest.raises(Exception, match="malformed timestamp: 08:30"):
        load(spark, path)
    events, aside = X.quarantined_events(X.read_export(spark, path, COLUMNS), "fsm")
    assert events.count() == 1
    row, = aside.collect()
    assert row.source_path.endswith("x.csv") and json.loads(row.raw)["raw_ts"] == "08:30"


def test_timestamps(spark):
    day = 1_768_465_800.0
    spelled = {
        "2026-01-15T08:30:00": day, "2026-01-15T08:30:00+00:00": day, "2026-01-15T08:30Z": day,
        "20260115T083000": day, "2026-01-15 14:00:00.5+0530": day + 0.5, "1_000": 1000.0, "-1.5e3": -1500.0,
        "2026-01-15": day - 30_600, " 1700000000 ": 1_700_000_000.0,
        "1e400": None, "nan": None, "-inf": None, "08:30": None, "1d": None, "2026-13-01": None, "x": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in spelled], "t string")
    found = df.select(F.unix_micros(parse_timestamp(F.col("t")))).collect()
    assert [None if r[0] is None else r[0] / 1e6 for r in found] == list(spelled.values())


def test_statuses(spark):
    raw = {"quote accepted": "QuoteApproved", " On Site": "Attended", "AS1851 routine": "RoutineService",
           "Custom Step ": "Custom Step"}
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r[0] for r in df.select(canonical_activity(F.col("r"))).collect()] == list(raw.values())


def test_files_are_read_in_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("b", "a", "c"):
        write(folder, f"{name}.csv", "job,status,when\n" + "".join(f"J,{name}{i:04d},1\n" for i in range(300)))
    events = load(spark, str(folder), X.ColumnMap("job", "status", "when"))
    assert [e.activity for e in events] == [f"{n}{i:04d}" for n in "abc" for i in range(300)]


def test_large_files_are_split_and_keep_their_order(spark, tmp_path):
    path = write(tmp_path, "x.csv", "job,status,when\n" + "".join(f"J,s{i:06d},1\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        raw = X.read_csv(spark, path, COLUMNS)
        assert raw.rdd.getNumPartitions() > 3
        ordered = [r.activity for r in raw.orderBy("ingest_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [f"s{i:06d}" for i in range(20_000)]


def test_xes_names_and_stored_log(spark, tmp_path):
    path = write(tmp_path, "x.csv", "case:concept:name,concept:name,time:timestamp,org:resource\n"
                                    "c1,Check ,2010-10-02T23:21:51.000+02:00,R1\nc1,Send,2010-10-03T00:21:51+02:00,R1\n")
    from casetrail.functions.text import strip
    log = X.load_export(spark, path, X.XES, str(tmp_path / "log"), normalise=strip)
    assert [tuple(r) for r in M.directly_follows(log).collect()] == [("Check", "Send", 1)]
    assert log.events.first().source_system == "real"


def test_rows_are_written_as_json_by_all_cores(spark, tmp_path):
    texts = [(i, f"line {i}\n\"quoted\"") for i in range(64)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read = jsonl_rows(spark, str(tmp_path))
    assert len(read.inputFiles()) > 4
    assert {tuple(r) for r in read.collect()} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}

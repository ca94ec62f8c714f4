from pyspark.sql import functions as F

from casetrail.operators import audit


def test_statements(spark):
    refused = ["insert into crates select * from holds", "Drop view tides", "update crates set kg = 0 where id = 9", "pragma user_version", " ", None,
               "with late as (select id from ships) delete from ships", "select 7 ; truncate holds", "explain update ships set at = 0",
               "ALTER TABLE holds ADD COLUMN x INT", "call refill()"]
    accepted = ["select id, kg from crates", "SELECT count(*) FROM holds;", "with a as (select 3 as n) select n + 1 from a", "\texplain select id from ships"]
    df = spark.createDataFrame([(s,) for s in refused + accepted], "sql string")
    assert [r.decision for r in audit.sql_audit(df).collect()] == ["deny"] * len(refused) + ["allow"] * len(accepted)


def test_tool_calls(spark):
    host = "tides.harbour.example"
    calls = [
        ("Edit", {"path": "log"}, "deny"), ("http", {"method": "put", "host": host}, "deny"),
        ("http", {"method": "head", "host": host}, "allow"), ("http", {"method": "GET", "host": "tides.harbour.example.evil.example"}, "deny"),
        ("http", {"host": ""}, "deny"), ("Fetch", {"url": "http://TIDES.harbour.example:8080/today"}, "allow"),
        ("warehouse_query", {"sql": "select max(kg) from crates"}, "allow"), ("warehouse_query", {"sql": "merge into crates using x on 1 = 1"}, "deny"),
        ("my_sql_tool", {"query": "with a as (select 2 as n) select n from a"}, "allow"), ("read", {"path": "log"}, "allow"), ("lower_the_bridge", {}, "deny")]
    df = spark.createDataFrame([(t, a) for t, a, _ in calls], "tool string, args map<string,string>")
    assert [r.decision for r in audit.tool_audit(df, [host]).collect()] == [d for _, _, d in calls]


def test_requests_become_audit_rows(spark):
    df = spark.createDataFrame([("get", "https://quay.example/list?p=2"), ("GET", "http://notquay.example"), ("PATCH", "https://quay.example"),
                                ("GET", "quay")], "method string, url string")
    judged = audit.egress_audit(df, ["quay.example"])
    rows = audit.audit_rows(judged, F.current_timestamp(), F.lit("bot"), F.lit("fetch"), F.col("url"), F.col("method"))
    assert [r.decision for r in rows.collect()] == ["allow", "deny", "deny", "deny"]
    assert rows.columns == ["ts", "actor", "action", "target", "verb", "decision", "reason"]

"""The given tables, read as event logs, entities and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.operators.mining import EventLog
from casetrail.operators.ordering import Grouped, long_groups, with_position

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """The ``events`` table: a case per user, recorded in ``event_id`` order."""
    events = table(spark, sf_dir, "events")
    return EventLog(events.select(
        F.col("event_id").alias("ingest_seq"),
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("").alias("resource"),
        F.lit("web").alias("source_system"),
        F.concat(F.lit("web.user."), F.col("user_id").cast("string")).alias("entity_fqn")),
        [str(user) for user in long_groups(events, "user_id", stored=True)], events.count())


LINE_ACTIVITY = {"NO": "Scheduled", "NF": "Attended", "AO": "JobComplete", "AF": "Invoice", "RO": "DefectRaised",
                 "RF": "RectifyComplete"}


def _technician(key: Column) -> Column:
    return F.concat(F.lit("tech-"), (key % 8).cast("string"))


def ranked_lines(spark: SparkSession, sf_dir: str) -> Grouped:
    """``lineitem`` with the position of each line in its order. Every thirteenth order was recorded by line number,
    the others by date, so the former carry timestamps that go back."""
    stored = table(spark, sf_dir, "lineitem")
    lines = Grouped(stored, "l_orderkey", long_groups(stored, "l_orderkey", stored=True))
    first = F.when(F.col("l_orderkey") % 13 == 0, F.col("l_linenumber")).otherwise(0)
    order = ["_recorded_by", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax"]
    ranked = lines.each(lambda rows, is_long: with_position(
        rows.withColumn("_recorded_by", first), "l_orderkey", order, "line_rank", is_long).drop("_recorded_by"))
    return Grouped(ranked, "l_orderkey", lines.long_keys)


def _event(seq: Column, case: Column, activity: Column, ts: Column, resource: Column, system: Column,
           fqn: Column) -> Column:
    return F.struct(
        seq.cast("long").alias("ingest_seq"), case.alias("case_id"), activity.alias("activity"), ts.alias("ts"),
        resource.alias("resource"), system.alias("source_system"), fqn.alias("entity_fqn"))


def _unfolded(rows: DataFrame, *events: Column) -> DataFrame:
    """One row per event that is not NULL, from one pass over ``rows``."""
    return rows.select(F.inline(F.array(*events))).where("case_id is not null")


def job_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """A job-to-cash log: quotes from ``orders``, the work on them from ``lineitem``, services on large lines."""
    orders = table(spark, sf_dir, "orders").withColumn("ordered", F.col("o_orderdate").cast("timestamp"))
    lines = ranked_lines(spark, sf_dir)
    order_key = F.col("o_orderkey").cast("string")
    fsm = F.lit("fsm")

    def job(key: Column) -> tuple[Column, Column]:
        return F.concat(F.lit("job-"), key), F.concat(F.lit("fsm.job."), key)

    case, work_item = job(order_key)
    quote = _event(F.lit(0), case, F.lit("Quote"), F.col("ordered"), _technician(F.col("o_custkey")), fsm, work_item)
    approval = _event(F.lit(1), case, F.lit("QuoteApproved"), F.col("ordered") + F.expr("interval 1 hour"),
                      _technician(F.col("o_orderkey")), fsm, work_item)
    quotes = _unfolded(orders, quote, F.when(F.col("o_orderstatus") != "P", approval))

    key = F.col("l_orderkey").cast("string")
    case, work_item = job(key)
    flag = F.concat("l_returnflag", "l_linestatus")
    activity = reduce(lambda col, kv: col.when(flag == kv[0], kv[1]), LINE_ACTIVITY.items(), F)
    billed = activity == "Invoice"
    shipped = F.col("l_shipdate").cast("timestamp")
    worker = _technician(F.col("l_suppkey"))
    work = _event(F.col("line_rank") + 1, case, activity,
                  F.greatest(shipped, F.col("ordered") + F.expr("interval 2 hours")), worker,
                  F.when(billed, "finance").otherwise("fsm"),
                  F.when(billed, F.concat(F.lit("finance.invoice."), key)).otherwise(work_item))
    service = _event(F.lit(0), F.concat(F.lit("svc-"), key, F.lit("-"), F.col("line_rank").cast("string")),
                     F.lit("RoutineService"), shipped, worker, F.lit("compliance"),
                     F.concat(F.lit("asset."), F.col("l_partkey").cast("string")))
    dated = lines.rows.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "ordered"), "l_orderkey")
    done = _unfolded(dated, work, F.when(F.col("l_quantity") >= 45, service))

    # two events of an order, two of a line at most; the footers tell how many of them there are
    most = 2 * (orders.count() + table(spark, sf_dir, "lineitem").count())
    return EventLog(quotes.unionByName(done), [f"job-{order}" for order in lines.long_keys], most)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and parts as citable entities."""

    def kind(name: str, system: str, key: str, title: str, attr: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{system}.{name}."), F.col(key).cast("string")).alias("fqn"), F.lit(name).alias("kind"),
            F.col(title).alias("name"), F.lit(system).alias("source_system"),
            F.create_map(F.lit(attr), F.col(attr).cast("string")).alias("attrs"))

    return (kind("customer", "crm", "c_custkey", "c_name", "c_mktsegment")
            .unionByName(kind("supplier", "erp", "s_suppkey", "s_name", "s_nationkey"))
            .unionByName(kind("part", "erp", "p_partkey", "p_name", "p_brand")))

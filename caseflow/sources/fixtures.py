"""Event logs derived from the driver tables (definitions in FIXTURES.md §3).

Each builder returns ``(DataFrame, LogCols, sla_hours)``.  Every log carries the
rich-log columns (case, activity, timestamp, seq, status, resource, cost,
deadline, group_code, priority, purpose_code, intervention_type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caseflow.functions.roles import LogCols
from caseflow.functions.timecols import HOUR_US, micros_between

# Fixed values of the fixture definitions (FIXTURES.md §3).
SLA_HOURS = {"log_day": 8.0, "log_session": 8.0, "log_user": 696.0, "log_order": 36000.0}
SESSION_GAP_HOURS = 12
PRIORITY_LOW_BELOW = 20
PRIORITY_MID_BELOW = 60

EVENT_COLS = LogCols()
ORDER_COLS = LogCols(tiebreak=("partkey", "suppkey", "cost"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_attrs(case: "F.Column", deadline: "F.Column") -> list:
    k = F.get_json_object("props", "$.k")
    return [
        case.alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"),
        k.alias("resource"),
        F.col("value").alias("cost"),
        deadline.alias("deadline"),
        (F.col("user_id") % 7).cast("string").alias("group_code"),
        F.when(F.col("value") < PRIORITY_LOW_BELOW, "low")
        .when(F.col("value") < PRIORITY_MID_BELOW, "mid")
        .otherwise("high").alias("priority"),
        (k.cast("int") % 5).cast("string").alias("purpose_code"),
        (F.col("event_id") % 3).cast("string").alias("intervention_type"),
    ]


def log_day(spark: SparkSession, sf_dir: str):
    """Case = user and calendar day; deadline = day start + 18 h."""
    ev = _table(spark, sf_dir, "events")
    case = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    deadline = F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")
    return ev.select(*_event_attrs(case, deadline)), EVENT_COLS, SLA_HOURS["log_day"]


def log_session(spark: SparkSession, sf_dir: str):
    """Case = a user's run of events with gaps of at most 12 h."""
    ev = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(),
                                              F.col("event_id").asc_nulls_last())
    prev = F.lag("ts").over(w)
    brk = F.when(prev.isNull() | (micros_between(prev, F.col("ts")) > SESSION_GAP_HOURS * HOUR_US), 1).otherwise(0)
    ev = ev.withColumn("_brk", brk).withColumn(
        "_sess", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    case = F.concat_ws("-", F.col("user_id").cast("string"), F.col("_sess").cast("string"))
    ev = ev.withColumn("_case", case)
    deadline = F.min("ts").over(Window.partitionBy("_case")) + F.expr("INTERVAL 24 HOURS")
    return ev.select(*_event_attrs(F.col("_case"), deadline)), EVENT_COLS, SLA_HOURS["log_session"]


def log_user(spark: SparkSession, sf_dir: str):
    """Case = user (long traces); deadline = first event + 29 days."""
    ev = _table(spark, sf_dir, "events")
    deadline = F.min("ts").over(Window.partitionBy("user_id")) + F.expr("INTERVAL 29 DAYS")
    return ev.select(*_event_attrs(F.col("user_id").cast("string"), deadline)), EVENT_COLS, SLA_HOURS["log_user"]


def log_order(spark: SparkSession, sf_dir: str):
    """Case = order; one event per line item at its ship date."""
    li = _table(spark, sf_dir, "lineitem")
    od = _table(spark, sf_dir, "orders")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    status = F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus"))
    df = j.select(
        F.col("l_orderkey").alias("case_id"),
        status.alias("activity"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_linenumber").alias("seq"),
        status.alias("status"),
        F.col("l_suppkey").cast("string").alias("resource"),
        F.col("l_extendedprice").alias("cost"),
        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("deadline"),
        (F.col("l_partkey") % 7).cast("string").alias("group_code"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("purpose_code"),
        F.col("l_returnflag").alias("intervention_type"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
    )
    return df, ORDER_COLS, SLA_HOURS["log_order"]


LOGS = {"log_day": log_day, "log_session": log_session, "log_user": log_user, "log_order": log_order}


def load_log(spark: SparkSession, sf_dir: str, name: str = "log_day"):
    return LOGS[name](spark, sf_dir)

"""Registered queries: sources, sinks, contract and profiling (S, C, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import contract as C
from caseflow.operators import labels as L
from caseflow.operators import profiling as P
from caseflow.plans.registry import register
from caseflow.plans.sqlparts import DAY, HOUR, LOG_SQL, enriched_sql
from caseflow.session import scratch_path
from caseflow.sources import csv as CSV
from caseflow.sources import sinks as S
from caseflow.sources import xes as X
from caseflow.sources.fixtures import load_log

LOG_DAY_COLS = ["case_id", "activity", "timestamp", "seq", "status", "resource", "cost", "deadline",
                "group_code", "priority", "purpose_code", "intervention_type"]
ORDER_NUM = ["seq", "cost", "quantity", "discount"]


def _with_log(log, body):
    return f"WITH log AS ({LOG_SQL[log]}) {body}"


def _q(c):
    return f'"{c}"'


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def raw_string_log(spark, sf_dir):
    """Events as an untyped text log: every 50th timestamp is junk."""
    ev = _events(spark, sf_dir)
    ts = F.when(F.col("event_id") % 50 == 0, F.lit("n/a")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return ev.select("event_id", F.col("user_id").cast("string").alias("case_id"),
                     F.col("event_type").alias("activity"), ts.alias("timestamp"),
                     F.get_json_object("props", "$.k").alias("resource"), F.col("value").alias("cost"))


RAW_SQL = """raw AS (SELECT event_id, CAST(user_id AS VARCHAR) AS case_id, event_type AS activity,
    CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp",
    json_extract_string(props, '$.k') AS resource, value AS cost FROM events)"""


def _r6(df, names):
    return df.withColumns({c: F.round(c, 6) for c in names})


# ---------------------------------------------------------------- P: profiling

@register("log_kpis", _with_log("log_day", """SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases,
count(DISTINCT activity) AS n_activities, strftime(min("timestamp"), '%Y-%m-%d') AS first_day,
strftime(max("timestamp"), '%Y-%m-%d') AS last_day FROM log"""))
def q_log_kpis(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return P.log_kpis(df, cols)


@register("log_overview", _with_log("log_order", """SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases,
count(DISTINCT activity) AS n_activities, count(DISTINCT resource) AS n_resources FROM log"""))
def q_log_overview(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    return P.log_overview(df, cols)


def _quality_sql():
    parts = [f"""SELECT '{c}' AS column_name, typeof(any_value({_q(c)})) AS type,
        count(*) - count({_q(c)}) AS nulls, round((count(*) - count({_q(c)})) * 100.0 / count(*), 2) AS pct_nulls,
        count(DISTINCT {_q(c)}) AS n_unique FROM log""" for c in LOG_DAY_COLS]
    return _with_log("log_day", "SELECT * FROM (" + " UNION ALL ".join(parts) +
                     ") ORDER BY pct_nulls DESC, n_unique DESC, column_name")


@register("quality_report", _quality_sql())
def q_quality_report(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_day")
    return P.quality_report(df)


@register("quality_risks", f"""WITH {RAW_SQL},
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE try_cast("timestamp" AS TIMESTAMP) IS NULL) AS bad_time,
        count(*) FILTER (WHERE case_id IS NULL) AS null_case, count(*) FILTER (WHERE activity IS NULL) AS null_activity
      FROM raw)
SELECT 'bad_timestamps' AS risk, bad_time AS n_bad, CAST(bad_time > n * 0.01 AS INTEGER) AS flagged FROM a
UNION ALL SELECT 'null_case_id', null_case, CAST(null_case > 0 AS INTEGER) FROM a
UNION ALL SELECT 'null_activity', null_activity, CAST(null_activity > 0 AS INTEGER) FROM a""")
def q_quality_risks(spark, sf_dir):
    from caseflow.functions.roles import LogCols
    return P.quality_risks(raw_string_log(spark, sf_dir), LogCols())


def _describe_sql():
    parts = [f"""SELECT '{c}' AS column_name, count({c}) AS count,
        CAST(sum(CAST({c} AS DECIMAL(28,2))) AS DOUBLE) / count({c}) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(max({c}), 6) AS max FROM log""" for c in ORDER_NUM]
    return _with_log("log_order", " UNION ALL ".join(parts))


@register("describe_numeric", _describe_sql())
def q_describe_numeric(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_order")
    return _r6(P.describe_numeric(df, ORDER_NUM, scale=2), ["std", "min", "p25", "p50", "p75", "max"])


@register("throughput_describe", _with_log("log_day", f"""SELECT count(h) AS n_cases, round(avg(h), 6) AS mean,
round(stddev_samp(h), 6) AS std, round(min(h), 6) AS min, round(quantile_cont(h, 0.5), 6) AS p50,
round(quantile_cont(h, 0.9), 6) AS p90, round(quantile_cont(h, 0.95), 6) AS p95, round(max(h), 6) AS max
FROM (SELECT (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / {HOUR} AS h
      FROM log WHERE case_id IS NOT NULL GROUP BY case_id)"""))
def q_throughput_describe(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return _r6(P.throughput_describe(df, cols), ["mean", "std", "min", "p50", "p90", "p95", "max"])


def _boxplot_sql():
    cols = ["cost", "quantity", "discount"]
    q = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM log""" for c in cols)
    lng = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM log" for c in cols)
    return _with_log("log_order", f""", q AS ({q}), f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
        q3 + 1.5 * (q3 - q1) AS upper_fence FROM q), lng AS ({lng})
    SELECT f.column_name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
        round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
        count(*) FILTER (WHERE value < lower_fence OR value > upper_fence) AS n_outliers
    FROM f JOIN lng ON f.column_name = lng.column_name
    GROUP BY f.column_name, q1, median, q3, iqr, lower_fence, upper_fence""").replace(") , q AS", "), q AS")


@register("boxplot_stats", _boxplot_sql())
def q_boxplot_stats(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_order")
    return _r6(P.boxplot_stats(df, ["cost", "quantity", "discount"]),
               ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"])


def _corr_sql():
    from itertools import combinations
    rows = []
    for a, b in combinations(ORDER_NUM, 2):
        rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM log")
        rows.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM log")
    rows += [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0 AS corr" for c in ORDER_NUM]
    return _with_log("log_order", " UNION ALL ".join(rows))


@register("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_order")
    return _r6(P.correlation_matrix(df, ORDER_NUM), ["corr"])


@register("class_balance", f"""WITH {enriched_sql('log_day')}
SELECT CAST(coalesce(lead_us > 8 * {HOUR}, false) AS INTEGER) AS late, count(*) AS n FROM enr GROUP BY 1 ORDER BY 1""")
def q_class_balance(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    return P.class_balance(L.label_sla(df, sla, cols, with_prefix=False), "late")


@register("attribute_values", _with_log("log_order", """SELECT resource, count(*) AS n FROM log
WHERE resource IS NOT NULL GROUP BY resource ORDER BY n DESC, resource"""))
def q_attribute_values(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_order")
    return P.attribute_values(df, "resource")


# ---------------------------------------------------------------- C: contract

def _contract_sql():
    present = {"case_id", "activity", "timestamp", "resource"}
    rows = []
    for c in C.RICH_COLUMNS:
        if c in present:
            unc = ("count(*) FILTER (WHERE \"timestamp\" IS NOT NULL AND try_cast(\"timestamp\" AS TIMESTAMP) IS NULL)"
                   if c == "timestamp" else "CAST(0 AS BIGINT)")
            rows.append(f"SELECT '{c}' AS column_name, 1 AS present, count(*) FILTER (WHERE {_q(c)} IS NULL) AS n_null, "
                        f"{unc} AS n_uncastable FROM raw")
        else:
            rows.append(f"SELECT '{c}' AS column_name, 0 AS present, CAST(NULL AS BIGINT) AS n_null, "
                        f"CAST(NULL AS BIGINT) AS n_uncastable")
    return f"WITH {RAW_SQL} " + " UNION ALL ".join(rows)


@register("contract_check", _contract_sql())
def q_contract_check(spark, sf_dir):
    return C.contract_check(raw_string_log(spark, sf_dir))


@register("semantic_mapping", """SELECT event_id, ts AS "timestamp", user_id AS case_id, event_type AS activity,
value, props, props AS activity_orig FROM events""")
def q_semantic_mapping(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("activity", F.col("props"))
    return C.semantic_mapping(ev, case="user_id", activity="event_type", timestamp="ts")


@register("parse_strict", """SELECT event_id,
strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S') AS parsed FROM events""")
def q_parse_strict(spark, sf_dir):
    ev = _events(spark, sf_dir)
    txt = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    return ev.select("event_id", C.parse_strict(txt, "dd/MM/yyyy HH:mm:ss").alias("parsed"))


@register("parse_lenient", f"""WITH {RAW_SQL}
SELECT event_id, try_strptime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM raw""")
def q_parse_lenient(spark, sf_dir):
    raw = raw_string_log(spark, sf_dir)
    return raw.select("event_id", C.parse_lenient(F.col("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@register("canonicalise", """SELECT event_id, ts AS "timestamp", user_id AS case_id, event_type AS activity,
value, props, CAST(NULL AS VARCHAR) AS resource FROM events ORDER BY case_id, "timestamp" """)
def q_canonicalise(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return C.canonicalise(ev, {"user_id": "case_id", "event_type": "activity", "ts": "timestamp"})


# ---------------------------------------------------------------- S: sources & sinks

@register("read_csv_log", _with_log("log_day", "SELECT * EXCLUDE (cost), round(cost, 6) AS cost FROM log"))
def q_read_csv_log(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_day")
    path = scratch_path(spark, "csv-log")
    CSV.write_csv(df, path)
    out = CSV.read_event_csv(spark, path, CSV.RICH_SCHEMA, time_cols=("timestamp", "deadline"))
    return out.withColumn("cost", F.round("cost", 6))


@register("read_csv_renamed", _with_log("log_day", """SELECT case_id, activity, "timestamp", seq, status, resource,
round(cost, 6) AS cost, deadline, group_code, priority, purpose_code, intervention_type FROM log"""))
def q_read_csv_renamed(spark, sf_dir):
    """The rich log under its own headers, in another order and with a further column."""
    df, _, _ = load_log(spark, sf_dir, "log_day")
    own = {**C.RICH_COLUMNS, "cost": "Cost"}
    path = scratch_path(spark, "csv-renamed")
    CSV.write_csv(df.select(*[F.col(n).alias(own[n]) for n in sorted(own, reverse=True)], F.lit("x").alias("note")), path)
    out = CSV.read_event_csv(spark, path, CSV.RICH_SCHEMA, time_cols=("timestamp", "deadline"))
    return out.withColumn("cost", F.round("cost", 6))


@register("read_csv_directory", _with_log("log_day", """SELECT case_id, activity, "timestamp", seq, status, resource,
CASE WHEN seq % 2 = 0 THEN round(cost, 6) END AS cost, deadline, group_code, priority, purpose_code, intervention_type FROM log"""))
def q_read_csv_directory(spark, sf_dir):
    """A directory of files with differing headers: own order and names, and a file without costs."""
    df, _, _ = load_log(spark, sf_dir, "log_day")
    own = {**C.RICH_COLUMNS, "cost": "Cost"}
    path = scratch_path(spark, "csv-directory")
    CSV.write_csv(df.where("seq % 2 = 0"), path)
    CSV.write_csv(df.where("seq % 2 <> 0 or seq is null").select(*[F.col(n).alias(own[n]) for n in sorted(own, reverse=True) if n != "cost"]),
                  path, mode="append")
    out = CSV.read_event_csv(spark, path, CSV.RICH_SCHEMA, time_cols=("timestamp", "deadline"))
    return out.withColumn("cost", F.round("cost", 6))


@register("read_csv_dayfirst", """SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts, value
FROM events""")
def q_read_csv_dayfirst(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_type",
                                       F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("ts"), "value")
    path = scratch_path(spark, "csv-dayfirst")
    CSV.write_csv(ev, path, sep=";")
    return CSV.read_dayfirst_csv(spark, path, "event_id bigint, user_id bigint, event_type string, ts string, "
                                              "value double", time_cols=("ts",))


@register("read_xes_log", _with_log("log_day", 'SELECT case_id, activity, "timestamp", resource FROM log'))
def q_read_xes_log(spark, sf_dir):
    df, _, _ = load_log(spark, sf_dir, "log_day")
    path = scratch_path(spark, "xes")
    X.write_xes(df, path, order=["timestamp", "seq"])
    return X.read_xes(spark, path)


@register("write_log_roundtrip", f"""WITH {enriched_sql('log_day')}
SELECT case_id, seq, activity, "timestamp", transition, time_to_next, lead_time,
       CAST(coalesce(lead_us > 8 * {HOUR}, false) AS INTEGER) AS late FROM enr
WHERE coalesce(lead_us > 8 * {HOUR}, false)""")
def q_write_log_roundtrip(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    late = L.label_sla(df, sla, cols, with_prefix=False).where("late = 1") \
        .select("case_id", "seq", "activity", "timestamp", "transition", "time_to_next", "lead_time", "late")
    return S.roundtrip_parquet(spark, late, scratch_path(spark, "late-cases"))


@register("preview", _with_log("log_day", """SELECT * FROM log
ORDER BY case_id ASC NULLS LAST, "timestamp" ASC NULLS LAST, seq ASC NULLS LAST LIMIT 200"""))
def q_preview(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return S.preview(df, cols, 200)


DAY = DAY

"""Registered queries: case features and case-level targets (F, L5–L9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import labels as L
from caseflow.operators.case_features import build_case_features
from caseflow.plans.registry import register
from caseflow.plans.sqlparts import HOUR, LOG_SQL, ORDER_SQL
from caseflow.sources.fixtures import load_log


def _rev(order: str) -> str:
    return order.replace("ASC NULLS LAST", "DESC NULLS FIRST")


def case_features_sql(log: str, sla: float | None, *, extra=(), throughput=True, num_events=True,
                      uniq=True, rework=True, start=True, end=True, start_res=True, mean_cost=True,
                      extra_sel: str = "", src: str = "log") -> str:
    """DuckDB twin of :func:`build_case_features` (one row per non-null case)."""
    o = ORDER_SQL[log]
    s = ["case_id", f'(epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / {HOUR} AS throughput_hours']
    if num_events:
        s.append("count(*) AS num_events")
    if uniq:
        s.append("count(DISTINCT activity) AS num_unique_activities")
    if rework and num_events and uniq:
        s.append("count(*) - count(DISTINCT activity) AS rework_count")
    if start:
        s.append(f"first(activity ORDER BY {o}) FILTER (WHERE activity IS NOT NULL) AS start_activity")
    if end:
        s.append(f"first(activity ORDER BY {_rev(o)}) FILTER (WHERE activity IS NOT NULL) AS end_activity")
    if start_res:
        s.append(f"first(resource ORDER BY {o}) FILTER (WHERE resource IS NOT NULL) AS start_resource")
    if mean_cost:
        s.append("avg(CAST(cost AS DOUBLE)) AS mean_cost")
    for c in extra:
        s.append(f"avg(CAST({c} AS DOUBLE)) AS {c}")
    if extra_sel:
        s.append(extra_sel)
    inner = f"SELECT {', '.join(s)} FROM {src} WHERE case_id IS NOT NULL GROUP BY case_id"
    tgt = f", CAST(coalesce(throughput_hours > {sla}, false) AS INTEGER) AS sla_violated" if sla is not None else ""
    excl = "" if throughput else " EXCLUDE (throughput_hours)"
    return f"SELECT *{excl}{tgt} FROM ({inner})" if (tgt or excl) else inner


def _with_log(log: str, body: str) -> str:
    return f"WITH log AS ({LOG_SQL[log]}) {body}"


def _round_doubles(df, digits=9):
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields
                           if f.dataType.typeName() == "double"})


@register("case_features", _with_log("log_day", f"""SELECT * REPLACE (round(mean_cost, 6) AS mean_cost)
FROM ({case_features_sql('log_day', 8)})"""))
def q_case_features(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    return build_case_features(df, sla, cols).withColumn("mean_cost", F.round("mean_cost", 6))


@register("rework", _with_log("log_user", f"""SELECT case_id, num_events, num_unique_activities, rework_count
FROM ({case_features_sql('log_user', None)})"""))
def q_rework(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_user")
    return build_case_features(df, None, cols, include_default_target=False) \
        .select("case_id", "num_events", "num_unique_activities", "rework_count")


@register("start_end", _with_log("log_order", f"""SELECT case_id, start_activity, end_activity
FROM ({case_features_sql('log_order', None)})"""))
def q_start_end(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    return build_case_features(df, None, cols, include_default_target=False) \
        .select("case_id", "start_activity", "end_activity")


@register("start_resource", _with_log("log_session", f"""SELECT case_id, start_resource
FROM ({case_features_sql('log_session', None)})"""))
def q_start_resource(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_session")
    return build_case_features(df, None, cols, include_default_target=False).select("case_id", "start_resource")


@register("mean_cost", _with_log("log_order", f"""SELECT case_id, round(mean_cost, 6) AS mean_cost
FROM ({case_features_sql('log_order', None)})"""))
def q_mean_cost(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    out = build_case_features(df, None, cols, include_default_target=False)
    return out.select("case_id", F.round("mean_cost", 6).alias("mean_cost"))


@register("extra_numeric", _with_log("log_order", f"""SELECT case_id, round(quantity, 6) AS quantity,
round(discount, 6) AS discount FROM ({case_features_sql('log_order', None, extra=('quantity', 'discount'))})"""))
def q_extra_numeric(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    out = build_case_features(df, None, cols, include_default_target=False,
                              extra_numeric_cols=["quantity", "discount", "not_a_column"])
    return out.select("case_id", F.round("quantity", 6).alias("quantity"),
                      F.round("discount", 6).alias("discount"))


@register("case_features_minimal", _with_log("log_session", case_features_sql(
    "log_session", 8, uniq=False, rework=False, start=False, end=False, start_res=False, mean_cost=False)))
def q_case_features_minimal(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_session")
    return build_case_features(df, sla, cols, include_num_unique_activities=False, include_rework_count=False,
                               include_start_activity=False, include_end_activity=False,
                               include_start_resource=False, include_mean_cost=False)


@register("case_features_noleak", _with_log("log_day", f"""SELECT * EXCLUDE (mean_cost) FROM
({case_features_sql('log_day', 8, throughput=False)})"""))
def q_case_features_noleak(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    return build_case_features(df, sla, cols, include_throughput_feature=False,
                               drop_feature_cols=["mean_cost", "absent_col"])


@register("target_sla", _with_log("log_user", f"""SELECT case_id, throughput_hours, sla_violated FROM
({case_features_sql('log_user', 696)})"""))
def q_target_sla(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_user")
    return build_case_features(df, sla, cols).select("case_id", "throughput_hours", "sla_violated")


@register("target_above_median", _with_log("log_session", f"""SELECT case_id, throughput_hours,
CAST(coalesce(throughput_hours > (SELECT median(throughput_hours) FROM c0), false) AS INTEGER) AS target
FROM c0""").replace("WITH log AS", "WITH log AS", 1).replace(
    ") SELECT case_id, throughput_hours,",
    f"), c0 AS ({case_features_sql('log_session', None)}) SELECT case_id, throughput_hours,", 1))
def q_target_above_median(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_session")
    cases = build_case_features(df, None, cols, include_default_target=False)
    return L.above_median_target(cases).select("case_id", "throughput_hours", "target")


@register("target_attribute", _with_log("log_order", f"""SELECT * EXCLUDE (quantity, mean_cost),
CAST(coalesce(quantity > 25.0, false) AS INTEGER) AS target
FROM ({case_features_sql('log_order', None, extra=('quantity',))})"""))
def q_target_attribute(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    cases = build_case_features(df, None, cols, include_default_target=False, extra_numeric_cols=["quantity"],
                                target_builders=[L.attribute_target("quantity", 25.0)],
                                drop_feature_cols=["quantity", "mean_cost"])
    return cases


@register("target_builders", _with_log("log_day", f"""SELECT case_id, sla_violated,
CAST(coalesce(mean_cost > 50.0, false) AS INTEGER) AS costly,
CAST(num_events >= 3 AS INTEGER) AS busy
FROM ({case_features_sql('log_day', 8)})"""))
def q_target_builders(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    busy = lambda cases: {"busy": (F.col("num_events") >= 3).cast("int")}
    cases = build_case_features(df, sla, cols,
                                target_builders=[L.attribute_target("mean_cost", 50.0, "costly"), busy])
    return cases.select("case_id", "sla_violated", "costly", "busy")


@register("target_from_events", f"""WITH {__import__('caseflow.plans.sqlparts', fromlist=['x']).enriched_sql('log_day')},
lab AS (SELECT *, CAST(coalesce(lead_us > 8 * {HOUR}, false) AS INTEGER) AS late FROM enr)
SELECT case_id, num_events, target FROM ({case_features_sql('log_day', None, src='lab',
                                          extra_sel='CAST(max(late) AS INTEGER) AS target')})""")
def q_target_from_events(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    lab = L.label_sla(df, sla, cols, with_prefix=False)
    cases = build_case_features(lab, None, cols, include_default_target=False,
                                extra_aggs={"target": F.max("late").cast("int")})
    return cases.select("case_id", "num_events", "target")

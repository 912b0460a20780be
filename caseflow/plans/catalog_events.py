"""Registered queries: sequence columns, labels and rankings (W, L, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import sketches as S
from caseflow.operators import labels as L
from caseflow.operators import rankings as B
from caseflow.operators import sequence as W
from caseflow.plans.registry import register
from caseflow.plans.sqlparts import DAY, HOUR, LOG_SQL, case_traces_sql, enriched_sql
from caseflow.sources.fixtures import load_log

R6 = 6


def _log_cte(log):
    return f"log AS ({LOG_SQL[log]})"


def _r(c, d=R6):
    return F.round(c, d)


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = f"""WITH {enriched_sql('log_day')},
lab AS (SELECT *, CAST(coalesce(lead_us > 8 * {HOUR}, false) AS INTEGER) AS late FROM enr)
SELECT transition, count(*) AS n,
       round(avg(time_to_next) * 24.0, 6) AS mean_hours,
       round(median(time_to_next) * 24.0, 6) AS median_hours
FROM lab WHERE late = 1 AND transition IS NOT NULL AND time_to_next IS NOT NULL
GROUP BY transition ORDER BY mean_hours DESC, transition LIMIT 5"""


def late_transition_cost_df(spark, sf_dir, log="log_day", top_n=5):
    """Which transitions cost most time in cases that break the SLA (hours)."""
    df, cols, sla = load_log(spark, sf_dir, log)
    late = B.late_events(L.label_sla(df, sla, cols, with_prefix=False))
    return B.transition_stats(late, top_n=top_n, scale=24.0,
                              mean_name="mean_hours", median_name="median_hours")


register("late_transition_cost", FLAGSHIP_SQL)(late_transition_cost_df)


# ---------------------------------------------------------------- W: sequence


@register("prefix_trace_list", f"""WITH {enriched_sql('log_day', prefix=True)}
SELECT case_id, seq, trace_list FROM enr""")
def q_prefix_trace_list(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return W.add_prefix_trace(df, cols).select("case_id", "seq", "trace_list")


@register("prefix_trace", f"""WITH {enriched_sql('log_session', prefix=True)}
SELECT case_id, seq, trace FROM enr""")
def q_prefix_trace(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_session")
    return W.add_prefix_trace(df, cols).select("case_id", "seq", "trace")


@register("transitions", f"""WITH {enriched_sql('log_order')}
SELECT case_id, seq, partkey, suppkey, cost, transition FROM enr""")
def q_transitions(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    return W.add_transitions(df, cols).select("case_id", "seq", "partkey", "suppkey", "cost", "transition")


@register("time_to_next", f"""WITH {enriched_sql('log_day')}
SELECT case_id, seq, time_to_next FROM enr""")
def q_time_to_next(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return W.add_time_to_next(df, cols).select("case_id", "seq", "time_to_next")


@register("lead_time", f"""WITH {enriched_sql('log_user')}
SELECT case_id, seq, lead_time FROM enr""")
def q_lead_time(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_user")
    return W.add_lead_time(df, cols).select("case_id", "seq", "lead_time")


@register("enrich_log", f"""WITH {enriched_sql('log_day', prefix=True)}
SELECT case_id, seq, trace, transition, time_to_next, lead_time FROM enr""")
def q_enrich_log(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return W.enrich(df, cols).select("case_id", "seq", "trace", "transition", "time_to_next", "lead_time")


# ---------------------------------------------------------------- L: labels

_LATE_SLA = f"CAST(coalesce(lead_us > {{sla}} * {HOUR}, false) AS INTEGER)"
_DELAY_SLA = (f"round(CASE WHEN coalesce(lead_us > {{sla}} * {HOUR}, false) "
              f"THEN greatest(0.0, (lead_us - {{sla}} * {HOUR}) / {DAY}) ELSE 0.0 END, 6)")


def _sla_sql(sla):
    return _LATE_SLA.format(sla=sla), _DELAY_SLA.format(sla=sla)


@register("label_sla", f"""WITH {enriched_sql('log_day')}
SELECT case_id, seq, lead_time, {_sla_sql(8)[0]} AS late, {_sla_sql(8)[1]} AS delay FROM enr""")
def q_label_sla(spark, sf_dir):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    out = L.label_sla(df, sla, cols, with_prefix=False)
    return out.select("case_id", "seq", "lead_time", "late", _r(F.col("delay")).alias("delay"))


@register("label_boxplot", f"""WITH {enriched_sql('log_session')},
cs AS (SELECT case_id, max(lead_us) AS lead_us FROM enr WHERE case_id IS NOT NULL GROUP BY case_id),
q AS (SELECT quantile_cont(CAST(lead_us AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST(lead_us AS DOUBLE), 0.75) AS q3 FROM cs),
f AS (SELECT q3 + 1.5 * (q3 - q1) AS fence_us FROM q)
SELECT case_id, seq, CAST(coalesce(lead_us > fence_us, false) AS INTEGER) AS late,
       round(CASE WHEN coalesce(lead_us > fence_us, false)
                  THEN greatest(0.0, (lead_us - fence_us) / {DAY}) ELSE 0.0 END, 6) AS delay,
       round(fence_us / {DAY}, 6) AS fence
FROM enr CROSS JOIN f""")
def q_label_boxplot(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_session")
    out = L.label_boxplot(df, cols, with_prefix=False)
    return out.select("case_id", "seq", "late", _r(F.col("delay")).alias("delay"),
                      _r(F.col("fence")).alias("fence"))


@register("label_deadline", f"""WITH {enriched_sql('log_day')},
cd AS (SELECT case_id, max("timestamp") AS last_ts, max(deadline) AS last_dl FROM log GROUP BY case_id)
SELECT e.case_id, e.seq,
       CAST(coalesce(e.case_id IS NOT NULL AND cd.last_ts > cd.last_dl, false) AS INTEGER) AS late,
       round(CASE WHEN coalesce(e.case_id IS NOT NULL AND cd.last_ts > cd.last_dl, false)
             THEN greatest(0.0, (epoch_us(cd.last_ts) - epoch_us(cd.last_dl)) / {DAY}) ELSE 0.0 END, 6) AS delay
FROM enr e LEFT JOIN cd ON e.case_id = cd.case_id""")
def q_label_deadline(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    out = L.label_deadline(df, cols, with_prefix=False)
    return out.select("case_id", "seq", "late", _r(F.col("delay")).alias("delay"))


# ---------------------------------------------------------------- B: rankings

def _late_day(spark, sf_dir, with_prefix=False):
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    return L.label_sla(df, sla, cols, with_prefix=with_prefix), cols


def _lab_sql(prefix=False):
    return f"""WITH {enriched_sql('log_day', prefix=prefix)},
lab AS (SELECT *, {_sla_sql(8)[0]} AS late FROM enr)"""


@register("late_events", f"""{_lab_sql()}
SELECT case_id, seq, activity, "timestamp", lead_time FROM lab WHERE late = 1""")
def q_late_events(spark, sf_dir):
    lab, _ = _late_day(spark, sf_dir)
    return B.late_events(lab).select("case_id", "seq", "activity", "timestamp", "lead_time")


@register("late_kpis", f"""{_lab_sql()},
pc AS (SELECT case_id, epoch_us(max("timestamp")) - epoch_us(min("timestamp")) AS lead_us
       FROM lab WHERE late = 1 AND case_id IS NOT NULL GROUP BY case_id)
SELECT count(*) AS late_cases, round(avg(lead_us) / {DAY}, 6) AS mean_lead_time,
       round(max(lead_us) / {DAY}, 6) AS max_lead_time, round(min(lead_us) / {DAY}, 6) AS min_lead_time
FROM pc""")
def q_late_kpis(spark, sf_dir):
    lab, cols = _late_day(spark, sf_dir)
    k = B.late_kpis(lab, cols)
    return k.select("late_cases", *[_r(F.col(c)).alias(c) for c in
                                    ("mean_lead_time", "max_lead_time", "min_lead_time")])


_FREQ = {
    "freq_activity": ("activity", False),
    "freq_resource": ("resource", False),
    "freq_prefix": ("trace", False),
    "freq_transition": ("transition", False),
    "freq_group": ("group_code", False),
    "freq_late_activity": ("activity", True),
    "freq_late_resource": ("resource", True),
    "freq_late_prefix": ("trace", True),
    "freq_late_transition": ("transition", True),
}


def _make_freq(name, column, late_only):
    prefix = column == "trace"
    sql = f"""{_lab_sql(prefix=prefix)}
SELECT {column}, count(*) AS n FROM lab WHERE {column} IS NOT NULL {"AND late = 1" if late_only else ""}
GROUP BY {column} ORDER BY n DESC, {column}"""

    def q(spark, sf_dir):
        lab, _ = _late_day(spark, sf_dir, with_prefix=prefix)
        src = B.late_events(lab) if late_only else lab
        return B.frequency(src, column)

    register(name, sql)(q)


for _name, (_col, _late) in _FREQ.items():
    _make_freq(_name, _col, _late)


@register("final_trace_freq", f"""WITH {_log_cte('log_day')},
t AS ({case_traces_sql('log_day')})
SELECT trace, count(*) AS n FROM t GROUP BY trace ORDER BY n DESC, trace""")
def q_final_trace_freq(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return B.final_trace_frequency(df, cols)


def _make_cases_per(name, attr):
    sql = f"""WITH log AS ({LOG_SQL['log_day']}),
p AS (SELECT DISTINCT case_id, {attr} FROM log WHERE case_id IS NOT NULL AND {attr} IS NOT NULL)
SELECT {attr}, count(*) AS n_cases FROM p GROUP BY {attr} ORDER BY n_cases DESC, {attr}"""

    def q(spark, sf_dir):
        df, cols, _ = load_log(spark, sf_dir, "log_day")
        return B.cases_per_value(df, attr, cols)

    register(name, sql)(q)


for _name, _attr in {"cases_per_group": "group_code", "cases_per_priority": "priority",
                     "cases_per_intervention": "intervention_type",
                     "cases_per_purpose": "purpose_code"}.items():
    _make_cases_per(_name, _attr)


@register("top_traces", f"""WITH {_log_cte('log_day')}, t AS ({case_traces_sql('log_day')})
SELECT case_id, trace, lead_us / {DAY} AS lead_time FROM t
ORDER BY lead_time DESC NULLS LAST, case_id LIMIT 30""")
def q_top_traces(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return B.top_traces(df, cols, top_n=30)


@register("top_transitions", f"""WITH {enriched_sql('log_day')}
SELECT case_id, transition, time_to_next FROM enr
WHERE transition IS NOT NULL AND time_to_next IS NOT NULL
ORDER BY time_to_next DESC, case_id, "timestamp" ASC NULLS LAST, seq ASC NULLS LAST LIMIT 30""")
def q_top_transitions(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return B.top_transitions(W.enrich(df, cols, with_prefix=False), cols, top_n=30)


@register("trace_stats", f"""WITH {_log_cte('log_day')}, t AS ({case_traces_sql('log_day')})
SELECT trace, count(*) AS n_cases, round(avg(lead_us) / {DAY}, 6) AS mean_lead_time,
       round(median(lead_us) / {DAY}, 6) AS median_lead_time
FROM t GROUP BY trace ORDER BY mean_lead_time DESC, trace LIMIT 30""")
def q_trace_stats(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return B.trace_stats(df, cols, top_n=30)


@register("transition_stats", f"""WITH {enriched_sql('log_day')}
SELECT transition, count(*) AS n, round(avg(time_to_next), 6) AS mean_time,
       round(median(time_to_next), 6) AS median_time
FROM enr WHERE transition IS NOT NULL AND time_to_next IS NOT NULL
GROUP BY transition ORDER BY mean_time DESC, transition LIMIT 30""")
def q_transition_stats(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    return B.transition_stats(W.enrich(df, cols, with_prefix=False), top_n=30)


@register("variants", f"""WITH {_log_cte('log_session')},
t AS ({case_traces_sql('log_session', value='activity', sep=' > ')})
SELECT trace AS variant, count(*) AS n FROM t GROUP BY trace ORDER BY n DESC, variant LIMIT 10""")
def q_variants(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_session")
    return B.variants(df, cols, top_n=10)


@register("dfg", f"""WITH {_log_cte('log_order')},
p AS (SELECT activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY
      "timestamp" ASC NULLS LAST, seq ASC NULLS LAST, partkey ASC NULLS LAST, suppkey ASC NULLS LAST,
      cost ASC NULLS LAST) AS dst FROM log WHERE case_id IS NOT NULL)
SELECT src, dst, count(*) AS n FROM p WHERE src IS NOT NULL AND dst IS NOT NULL
GROUP BY src, dst ORDER BY n DESC, src, dst""")
def q_dfg(spark, sf_dir):
    df, cols, _ = load_log(spark, sf_dir, "log_order")
    return B.directly_follows(df, cols)


# ---------------------------------------------------------------- approximate aggregates


@register("approx_gap_summary", f"""WITH {enriched_sql('log_day')}
SELECT activity, count(time_to_next) AS n, 1 AS p50_in_bound, 1 AS p95_in_bound, 1 AS n_cases_in_bound
FROM enr GROUP BY activity""")
def q_approx_gap_summary(spark, sf_dir):
    """Per activity from merged daily sketches: median and 95 % gap and number of cases.

    Sketches are randomised, so the row states whether each estimate is within
    its bound of the exact rank and count (four standard errors for cases).
    """
    df, cols, _ = load_log(spark, sf_dir, "log_day")
    gaps = W.add_time_to_next(df, cols).select("activity", "case_id", "timestamp", "time_to_next")
    days = S.daily_sketches(gaps, "timestamp", ["activity"], "time_to_next", "case_id")
    est = S.read_sketches(S.merge_sketches(days, ["activity"]), ["activity"], {"p50": 0.5, "p95": 0.95})
    both = gaps.join(est.withColumnRenamed("activity", "_of"), F.col("activity").eqNullSafe(F.col("_of")))
    ranks = both.groupBy("activity").agg(
        F.max("n").alias("n"), F.max("n_distinct").alias("est"), F.count_distinct("case_id").alias("exact"),
        *[F.count_if(F.col("time_to_next") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")],
        *[F.count_if(F.col("time_to_next") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p95")])
    slack = F.lit(S.rank_error()) * F.col("n") + 1

    def in_bound(p, share):
        at = F.col("n") * share
        return ((at >= F.col(f"{p}_below") - slack) & (at <= F.col(f"{p}_upto") + slack)).cast("int").alias(f"{p}_in_bound")
    cases = F.abs(F.col("est") - F.col("exact")) <= 4 * S.distinct_error() * F.col("exact") + 1
    return ranks.select("activity", "n", in_bound("p50", 0.5), in_bound("p95", 0.95),
                        cases.cast("int").alias("n_cases_in_bound"))

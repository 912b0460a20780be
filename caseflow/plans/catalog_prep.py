"""Registered queries: dataset preparation and evaluation (D, E, M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import evaluate as E
from caseflow.operators import prepare as D
from caseflow.operators.case_features import build_case_features
from caseflow.plans.catalog_cases import case_features_sql
from caseflow.plans.registry import register
from caseflow.plans.sqlparts import LOG_SQL
from caseflow.sources.fixtures import load_log

LABEL = "sla_violated"
NUMERIC = ["num_events", "num_unique_activities", "mean_cost", "rework_count"]
CATEGORICAL = ["start_activity", "end_activity", "start_resource"]


def case_table(spark, sf_dir):
    """log_day cases with the 8 h SLA label; throughput dropped (it defines the label)."""
    df, cols, sla = load_log(spark, sf_dir, "log_day")
    return build_case_features(df, sla, cols, include_throughput_feature=False)


def split_cases(spark, sf_dir):
    return D.stratified_split(case_table(spark, sf_dir), LABEL)


CASES_SQL = f"""log AS ({LOG_SQL['log_day']}), c AS ({case_features_sql('log_day', 8, throughput=False)}),
k AS (SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY md5('42:' || CAST(case_id AS VARCHAR)), case_id) - 1 AS r,
        count(*) OVER (PARTITION BY {LABEL}) AS n FROM c),
sp AS (SELECT * EXCLUDE (r, n, nt, nv), CASE WHEN r < nt THEN 'test' WHEN r < nt + nv THEN 'val' ELSE 'train' END AS split
       FROM (SELECT *, ceil(n * 0.2) AS nt, ceil((n - ceil(n * 0.2)) * 0.25) AS nv FROM k))"""


@register("stratified_split", f"WITH {CASES_SQL} SELECT case_id, {LABEL}, split FROM sp")
def q_stratified_split(spark, sf_dir):
    return split_cases(spark, sf_dir).select("case_id", LABEL, "split")


@register("split_summary", f"""WITH {CASES_SQL} SELECT split, count(*) AS rows, CAST(sum({LABEL}) AS BIGINT) AS positives,
round(avg(CAST({LABEL} AS DOUBLE)), 3) AS rate FROM sp GROUP BY split ORDER BY split""")
def q_split_summary(spark, sf_dir):
    return D.split_summary(split_cases(spark, sf_dir), LABEL)


_MED = ", ".join(f"median(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train') AS m_{c}" for c in NUMERIC)
_IMP = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0), 6) AS {c}" for c in NUMERIC)


@register("impute_numeric", f"""WITH {CASES_SQL}, m AS (SELECT {_MED} FROM sp)
SELECT case_id, split, {_IMP} FROM sp CROSS JOIN m""")
def q_impute_numeric(spark, sf_dir):
    out = D.impute_numeric(split_cases(spark, sf_dir), NUMERIC)
    return out.select("case_id", "split", *[F.round(c, 6).alias(c) for c in NUMERIC])


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS k FROM sp WHERE split = 'train' AND {c} IS NOT NULL "
            f"GROUP BY {c}) ORDER BY k DESC, v LIMIT 1)")


@register("impute_categorical", f"""WITH {CASES_SQL}
SELECT case_id, {", ".join(f"coalesce(CAST({c} AS VARCHAR), {_mode_sql(c)}, 'missing') AS {c}" for c in CATEGORICAL)}
FROM sp""")
def q_impute_categorical(spark, sf_dir):
    out = D.impute_categorical(split_cases(spark, sf_dir), CATEGORICAL)
    return out.select("case_id", *CATEGORICAL)


_LONG = " UNION ALL ".join(f"SELECT case_id, split, '{c}' AS column_name, CAST({c} AS VARCHAR) AS category FROM sp"
                           for c in CATEGORICAL)
_SLOTS = f"""lng AS ({_LONG}),
slots AS (SELECT column_name, category, CAST(row_number() OVER (PARTITION BY column_name ORDER BY category) - 1 AS INTEGER) AS slot
          FROM (SELECT DISTINCT column_name, category FROM lng WHERE split = 'train'))"""


@register("one_hot", f"""WITH {CASES_SQL}, {_SLOTS}
SELECT l.case_id, l.split, l.column_name, l.category, s.slot FROM lng l
LEFT JOIN slots s ON l.column_name = s.column_name AND l.category IS NOT DISTINCT FROM s.category""")
def q_one_hot(spark, sf_dir):
    return D.one_hot_long(split_cases(spark, sf_dir), CATEGORICAL)


def _names_sql():
    num = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS slot, '{c}' AS name" for i, c in enumerate(NUMERIC))
    pos = " UNION ALL ".join(f"SELECT {i} AS col_pos, '{c}' AS column_name" for i, c in enumerate(CATEGORICAL))
    return f"""WITH {CASES_SQL}, {_SLOTS}, pos AS ({pos}),
w AS (SELECT p.column_name, p.col_pos, count(*) AS w FROM slots s JOIN pos p ON s.column_name = p.column_name
      GROUP BY p.column_name, p.col_pos),
b AS (SELECT column_name, {len(NUMERIC)} + coalesce(sum(w) OVER (ORDER BY col_pos ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS base FROM w)
{num} UNION ALL SELECT CAST(b.base + s.slot AS INTEGER) AS slot, s.column_name || '=' || s.category AS name
FROM slots s JOIN b ON s.column_name = b.column_name"""


@register("feature_names", _names_sql())
def q_feature_names(spark, sf_dir):
    return D.feature_names(split_cases(spark, sf_dir), NUMERIC, CATEGORICAL)


@register("sanitise", f"""WITH {CASES_SQL}
SELECT case_id, round(CASE WHEN rework_count = 0 THEN 1.7976931348623157e308
                          ELSE num_events / rework_count END, 6) AS rework_rate FROM sp""")
def q_sanitise(spark, sf_dir):
    c = split_cases(spark, sf_dir)
    rate = F.when(F.col("rework_count") == 0, F.lit(float("inf"))) \
        .otherwise(F.col("num_events") / F.col("rework_count"))
    out = D.sanitise(c.withColumn("rework_rate", rate), ["rework_rate"])
    return out.select("case_id", F.round("rework_rate", 6).alias("rework_rate"))


@register("class_weights", f"""WITH {CASES_SQL}, cn AS (SELECT {LABEL}, count(*) AS nc FROM sp GROUP BY {LABEL})
SELECT sp.case_id, sp.{LABEL}, round((SELECT sum(nc) FROM cn) / ((SELECT count(*) FROM cn) * cn.nc), 9) AS weight
FROM sp JOIN cn ON sp.{LABEL} = cn.{LABEL}""")
def q_class_weights(spark, sf_dir):
    out = D.class_weights(split_cases(spark, sf_dir), LABEL)
    return out.select("case_id", LABEL, F.round("weight", 9).alias("weight"))


# ---------------------------------------------------------------- E: evaluation on a surrogate score

def surrogate_scores(spark, sf_dir):
    """A deterministic score in [0, 1): (events − 1) / (events + 1); y = SLA label."""
    c = split_cases(spark, sf_dir)
    a = c.select("case_id", "split", F.col(LABEL).alias("y"), F.lit("events").alias("model"),
                 ((F.col("num_events") - 1) / (F.col("num_events") + 1)).alias("score"))
    b = c.select("case_id", "split", F.col(LABEL).alias("y"), F.lit("rework").alias("model"),
                 (F.col("rework_count") / (F.col("rework_count") + 1)).alias("score"))
    return a.unionByName(b)


SCORES_SQL = f"""{CASES_SQL},
sc AS (SELECT case_id, split, {LABEL} AS y, 'events' AS model, (num_events - 1) / (num_events + 1) AS score FROM sp
       UNION ALL SELECT case_id, split, {LABEL}, 'rework', rework_count / (rework_count + 1) FROM sp),
t AS (SELECT * FROM sc WHERE model = 'events' AND split = 'test'),
st AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM t GROUP BY score),
ct AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
        sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st)"""


def _test_scores(spark, sf_dir):
    s = surrogate_scores(spark, sf_dir)
    return s.where((F.col("model") == "events") & (F.col("split") == "test"))


def _r9(df, names):
    return df.withColumns({c: F.round(c, 9) for c in names})


@register("eval_auc", f"""WITH {SCORES_SQL}
SELECT round(sum(pos * (neg_below + neg / 2.0)) / (max(P) * max(N)), 9) AS auc FROM ct""")
def q_eval_auc(spark, sf_dir):
    return _r9(E.auc(_test_scores(spark, sf_dir)), ["auc"])


@register("eval_roc", f"""WITH {SCORES_SQL}
SELECT score AS threshold, round((N - neg_below) / N, 9) AS fpr, round((P - pos_below) / P, 9) AS tpr FROM ct
UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM (SELECT count(*) AS n FROM ct) WHERE n > 0""")
def q_eval_roc(spark, sf_dir):
    return _r9(E.roc_points(_test_scores(spark, sf_dir)), ["fpr", "tpr"])


_CELLS = """cells AS (SELECT g.*, yy.y, pp.pred FROM grp g, (VALUES (0), (1)) yy(y), (VALUES (0), (1)) pp(pred)),
cnt AS (SELECT {keys} y, CAST(score >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM src GROUP BY ALL),
cm AS (SELECT c.*, coalesce(n, 0) AS n FROM cells c LEFT JOIN cnt USING ({keys} y, pred))"""


def _report_sql(keys: list[str], src: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    grp = f"SELECT DISTINCT {', '.join(keys)} FROM src" if keys else "SELECT 1 AS one"
    body = f"""src AS ({src}), grp AS ({grp}), {_CELLS.format(keys=k)},
g AS (SELECT {k} CAST(sum(n) FILTER (WHERE y = 1 AND pred = 1) AS DOUBLE) AS tp,
        CAST(sum(n) FILTER (WHERE y = 0 AND pred = 1) AS DOUBLE) AS fp,
        CAST(sum(n) FILTER (WHERE y = 1 AND pred = 0) AS DOUBLE) AS fn,
        CAST(sum(n) FILTER (WHERE y = 0 AND pred = 0) AS DOUBLE) AS tn FROM cm GROUP BY ALL),
m AS (SELECT *,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
  tp + fn AS s1, tn + fp AS s0 FROM g),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
               CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM m)
SELECT {k} '0' AS label, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT {k} '1', round(p1, 9), round(r1, 9), round(f1, 9), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT {k} 'accuracy', NULL, NULL, round((tp + tn) / (s0 + s1), 9), CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT {k} 'macro avg', round((p0 + p1) / 2, 9), round((r0 + r1) / 2, 9), round((f0 + f1) / 2, 9), CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT {k} 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 9), round((r0 * s0 + r1 * s1) / (s0 + s1), 9),
  round((f0 * s0 + f1 * s1) / (s0 + s1), 9), CAST(s0 + s1 AS BIGINT) FROM f"""
    return body


@register("eval_report", f"""WITH {SCORES_SQL}, {_report_sql([], "SELECT * FROM t")}""")
def q_eval_report(spark, sf_dir):
    rep = E.classification_report(E.predictions(_test_scores(spark, sf_dir)))
    return _r9(rep, ["precision", "recall", "f1_score"])


@register("eval_confusion", f"""WITH {SCORES_SQL}, src AS (SELECT * FROM t), grp AS (SELECT 1 AS one),
{_CELLS.format(keys='')} SELECT y, pred, n FROM cm""")
def q_eval_confusion(spark, sf_dir):
    return E.confusion(E.predictions(_test_scores(spark, sf_dir)))


@register("eval_logloss", f"""WITH {SCORES_SQL}
SELECT round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(score, {E.LOGLOSS_EPS}), 1 - {E.LOGLOSS_EPS}))
                    ELSE ln(1 - least(greatest(score, {E.LOGLOSS_EPS}), 1 - {E.LOGLOSS_EPS})) END), 9) AS log_loss FROM t""")
def q_eval_logloss(spark, sf_dir):
    return _r9(E.log_loss(_test_scores(spark, sf_dir)), ["log_loss"])


@register("eval_report_long", f"""WITH {SCORES_SQL}, {_report_sql(["model", "split"], "SELECT * FROM sc")}""")
def q_eval_report_long(spark, sf_dir):
    rep = E.classification_report(E.predictions(surrogate_scores(spark, sf_dir)), keys=["model", "split"])
    return _r9(rep, ["precision", "recall", "f1_score"])

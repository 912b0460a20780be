"""Registered queries: models, evaluation of models, explanation (M, E7, S5, X).

Learned models cannot be reproduced in SQL, so most keys here are rows-only.
The SHAP rankings are also registered over a linear explainer with fixed
coefficients, which DuckDB can recompute exactly.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caseflow.operators import evaluate as E
from caseflow.operators import explain as X
from caseflow.operators import models as M
from caseflow.operators import prepare as D
from caseflow.plans.catalog_prep import CASES_SQL, CATEGORICAL, LABEL, NUMERIC, case_table
from caseflow.plans.registry import register
from caseflow.session import scratch_path

def _written(spark, frame, name):
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.parquet(path)


def split_cases(spark, sf_dir):
    """Cases with their split, written once: the events would be folded again for each median, mode, index and use."""
    cases = _written(spark, case_table(spark, sf_dir), "cases")
    return _written(spark, D.stratified_split(cases, LABEL), "split")


def prepared(spark, sf_dir, split=None):
    """Fitted preparation and the prepared cases, written once: fits and scores read them again and again."""
    prep, frame = D.prepare_vectors(split_cases(spark, sf_dir) if split is None else split, NUMERIC, CATEGORICAL)
    return prep, _written(spark, frame, "prepared")


def slot_names(prep) -> list[str]:
    """Vector slot names from the fitted indexer: numeric first, then ``col=value``."""
    names = list(NUMERIC)
    idx = [s for s in prep.stages if hasattr(s, "labelsArray")]
    if idx:
        for col, labels in zip(CATEGORICAL, idx[0].labelsArray):
            names += [f"{col}={v}" for v in labels]
    return names


_FITTED: dict = {}  # application, data and kind → where the fitted preparation, the prepared cases and the model lie


def _once(spark, sf_dir, what, make):
    key = spark.sparkContext.applicationId, sf_dir, what
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def prepared_once(spark, sf_dir):
    split = _once(spark, sf_dir, "split", lambda: split_cases(spark, sf_dir))
    return _once(spark, sf_dir, "cases", lambda: prepared(spark, sf_dir, split))


def fitted(spark, sf_dir, kind):
    """Preparation, prepared cases and model of the full preset, fitted once a session and read back from shared scratch."""
    def once(what, make):
        return _once(spark, sf_dir, what, make)

    prep, cases = prepared_once(spark, sf_dir)

    def train():
        path = scratch_path(spark, kind)
        cells = None if kind == "logit" else once("cells", lambda: M.bin_train(cases, LABEL))
        PipelineModel(stages=[M.fit(cases, kind, LABEL, binned=cells)]).write().overwrite().save(path)
        return path
    return prep, cases, PipelineModel.load(once(kind, train)).stages[0]


def _scored(spark, sf_dir, kind, balanced=False):
    _, frame, model = fitted(spark, sf_dir, kind)
    if balanced:
        model = M.fit(frame, kind, LABEL, balanced=True)
    out = M.score(model, frame)
    return out.select("case_id", "split", F.col(LABEL).alias("y"), "score", "pred")


@register("prepare_vectors")
def q_prepare_vectors(spark, sf_dir):
    _, frame = prepared(spark, sf_dir)
    return frame.select("case_id", "split", LABEL, vector_to_array("features").alias("features"))


for _key, _kind in {"train_gbt": "gbt", "train_gbt_sampled": "gbt_sampled", "train_gbt_symmetric": "gbt_symmetric",
                    "train_forest": "forest", "train_logit": "logit"}.items():
    register(_key)(lambda spark, sf_dir, _k=_kind: _scored(spark, sf_dir, _k))


@register("train_balanced")
def q_train_balanced(spark, sf_dir):
    """M6 fed to a fit: the logistic model with balanced class weights."""
    return _scored(spark, sf_dir, "logit", balanced=True)


@register("score_cases")
def q_score_cases(spark, sf_dir):
    return _scored(spark, sf_dir, "gbt").where(F.col("split") == "test")


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """val/test AUC and class-1 precision, recall, F1 per model, by val AUC."""
    fitted(spark, sf_dir, "logit")  # prepares the cases, too; the other fits wait for jobs most of the time, so they run side by side
    fitted(spark, sf_dir, "gbt")    # and the cells of all trees
    with ThreadPoolExecutor(len(M.PRESETS)) as pool:
        models = list(pool.map(lambda kind: (kind, *fitted(spark, sf_dir, kind)[1:]), M.PRESETS))
    scored = None
    for kind, frame, m in models:
        s = M.score(m, frame.where(F.col("split").isin("val", "test")))
        s = s.select(F.lit(kind).alias("model"), "split", F.col(LABEL).alias("y"), "score", "pred")
        scored = s if scored is None else scored.unionByName(s)
    scored = _written(spark, scored, "scored")  # the report and both uses of the AUC would score again
    rep = E.classification_report(scored, keys=["model", "split"]).where(F.col("label") == "1") \
        .select("model", "split", "precision", "recall", "f1_score")
    auc = E.auc(scored, keys=["model", "split"])
    out = rep.join(auc, ["model", "split"])
    val_auc = out.where(F.col("split") == "val").select("model", F.col("auc").alias("_val_auc"))
    return out.join(val_auc, "model").orderBy(F.col("_val_auc").desc(), "model", "split").drop("_val_auc")


def tuned(spark, sf_dir):
    """Search and refit of the presets' ranges, run once a session."""
    key = spark.sparkContext.applicationId, sf_dir, "tuned"
    if key not in _FITTED:
        _, frame = prepared_once(spark, sf_dir)
        _FITTED[key] = frame, *M.tune(frame, LABEL)
    return _FITTED[key]


@register("tune_random")
def q_tune_random(spark, sf_dir):
    """M9: all trials with their parameters, rounds used and loss."""
    return tuned(spark, sf_dir)[1]


@register("tune_refit")
def q_tune_refit(spark, sf_dir):
    """M9: the best trial's model fitted again: losses by split, and whether its val loss is the trial's."""
    frame, _, best, model = tuned(spark, sf_dir)
    s = _written(spark, M.score(model, frame).select("split", F.col(LABEL).alias("y"), "score", "pred"), "scored")
    out = E.log_loss(s, keys=["split"]).join(E.auc(s, keys=["split"]), "split")
    same = F.when(F.col("split") == "val", F.abs(F.col("log_loss") - best["val_log_loss"]) < 1e-6)
    return out.withColumns({"trial": F.lit(best["trial"]), "rounds": F.lit(best["rounds"]), "best_is_refit": same})


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Save prep + model as one PipelineModel, load it back, score."""
    prep, frame, model = fitted(spark, sf_dir, "gbt")
    path = scratch_path(spark, "pipeline-model")
    PipelineModel(stages=list(prep.stages) + [model]).write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    split = _once(spark, sf_dir, "split", lambda: split_cases(spark, sf_dir))
    raw = D.sanitise(D.impute_categorical(D.impute_numeric(split, NUMERIC), CATEGORICAL), NUMERIC)
    out = loaded.transform(raw).withColumn("score", vector_to_array("probability")[1])
    return out.select("case_id", "split", "score", F.col("prediction").cast("int").alias("pred"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    prep, frame, model = fitted(spark, sf_dir, "gbt")
    return X.feature_importance(model, slot_names(prep), 15)


@register("shap_tree")
def q_shap_tree(spark, sf_dir):
    prep, frame, model = fitted(spark, sf_dir, "gbt")
    long, base = X.tree_shap(model, X.choose_split(frame, "test"), slot_names(prep))
    return long.crossJoin(base)


@register("shap_linear_model")
def q_shap_linear_model(spark, sf_dir):
    prep, frame, model = fitted(spark, sf_dir, "logit")
    long, base = X.linear_shap_from_model(model, X.choose_split(frame, "test"), slot_names(prep))
    return long.crossJoin(base)


# ---------------------------------------------------------------- SQL-checkable SHAP (fixed coefficients)

# Coefficients chosen here (not learned) for a linear explainer that SQL can recompute exactly.
FIXED_COEF = [0.4, -0.3, 0.01, 0.25]
FIXED_INTERCEPT = -1.0


def fixed_linear_shap(spark, sf_dir):
    c = X.choose_split(D.impute_numeric(split_cases(spark, sf_dir), NUMERIC), "test")
    vec = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(c)
    return X.linear_shap(vec, FIXED_COEF, FIXED_INTERCEPT, NUMERIC)


_MED = ", ".join(f"median(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train') AS m_{c}" for c in NUMERIC)
_LONG = " UNION ALL ".join(
    f"SELECT case_id, {i} AS slot, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0) AS value, "
    f"{FIXED_COEF[i]} AS coef FROM sp CROSS JOIN m WHERE split = 'test'" for i, c in enumerate(NUMERIC))
SHAP_SQL = f"""{CASES_SQL}, m AS (SELECT {_MED} FROM sp), lng AS ({_LONG}),
mu AS (SELECT slot, avg(value) AS mean FROM lng GROUP BY slot),
shp AS (SELECT l.case_id, CAST(l.slot AS INTEGER) AS slot, l.feature, l.value, l.coef * (l.value - mu.mean) AS shap
        FROM lng l JOIN mu ON l.slot = mu.slot)"""


def _r(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("shap_linear", f"""WITH {SHAP_SQL} SELECT case_id, slot, feature, round(value, 6) AS value,
round(shap, 6) AS shap FROM shp""")
def q_shap_linear(spark, sf_dir):
    long, _ = fixed_linear_shap(spark, sf_dir)
    return _r(long, ["value", "shap"])


@register("shap_long", f"""WITH {SHAP_SQL}, b AS (SELECT {FIXED_INTERCEPT} + sum(c.coef * mu.mean) AS base_value
FROM mu JOIN (SELECT DISTINCT slot, coef FROM lng) c ON mu.slot = c.slot)
SELECT case_id, feature, round(value, 6) AS value, round(shap, 6) AS shap, round(base_value, 6) AS base_value
FROM shp CROSS JOIN b""")
def q_shap_long(spark, sf_dir):
    long, base = fixed_linear_shap(spark, sf_dir)
    return _r(long.crossJoin(base).select("case_id", "feature", "value", "shap", "base_value"),
              ["value", "shap", "base_value"])


@register("shap_global", f"""WITH {SHAP_SQL} SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap
FROM shp GROUP BY feature ORDER BY mean_abs_shap DESC, feature""")
def q_shap_global(spark, sf_dir):
    long, _ = fixed_linear_shap(spark, sf_dir)
    return _r(X.shap_global(long), ["mean_abs_shap"])


@register("shap_dependence", f"""WITH {SHAP_SQL},
top AS (SELECT feature FROM shp GROUP BY feature ORDER BY avg(abs(shap)) DESC, feature LIMIT 1)
SELECT case_id, feature, round(value, 6) AS value, round(shap, 6) AS shap FROM shp WHERE feature = (SELECT feature FROM top)""")
def q_shap_dependence(spark, sf_dir):
    long, _ = fixed_linear_shap(spark, sf_dir)
    return _r(X.shap_dependence(long), ["value", "shap"])


@register("shap_describe", f"""WITH {SHAP_SQL} SELECT 'rework_count' AS feature, count(shap) AS count,
round(avg(shap), 6) AS mean, round(stddev_samp(shap), 6) AS std, round(min(shap), 6) AS min,
round(quantile_cont(shap, 0.25), 6) AS p25, round(quantile_cont(shap, 0.5), 6) AS p50,
round(quantile_cont(shap, 0.75), 6) AS p75, round(max(shap), 6) AS max FROM shp WHERE feature = 'rework_count'""")
def q_shap_describe(spark, sf_dir):
    long, _ = fixed_linear_shap(spark, sf_dir)
    return _r(X.shap_describe(long, "rework_count"), ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("shap_local", f"""WITH {SHAP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id
ORDER BY abs(shap) DESC, slot) AS rank FROM shp)
SELECT case_id, slot, feature, round(value, 6) AS value, round(shap, 6) AS shap, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 3""")
def q_shap_local(spark, sf_dir):
    long, _ = fixed_linear_shap(spark, sf_dir)
    out = X.shap_local(long, 3)
    return _r(out, ["value", "shap"]).withColumn("rank", F.col("rank").cast("int"))

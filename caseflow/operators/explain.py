"""Explanations (X1–X10): importance, linear and tree SHAP, and rankings.

SHAP values are a long frame ``(case_id, slot, feature, value, shap)`` with
the base value in a separate one-row frame; every ranking (global, local,
dependence, describe) is an aggregate or window over that frame, computed for
all cases at once.

Tree SHAP gives the path-dependent values of Lundberg, Erion and Lee
(arXiv:1802.03888), leaf by leaf for a whole batch of rows.  The fitted trees
are read from the model's saved node table (a model-sized array, broadcast) and
rows are explained in ``mapInPandas`` batches on the executors.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from caseflow.session import scratch_path

SHAP_ROWS = 10_000       # rows explained at a time
TASK_ROWS = 20_000       # rows that a task explains: much work a row, whatever the files they come from
TABLE_FEATURES = 8       # leaves of at most so many features keep a table of all patterns of met conditions

# ---------------------------------------------------------------- importance

def feature_importance(model, names: list[str], top_k: int | None = 15) -> DataFrame:
    """Tree-model feature importances with names, largest first (top k).

    Linear models have none: returns ``None`` (the reference skips them).
    """
    imp = getattr(model, "featureImportances", None)
    if imp is None:
        return None
    spark = _spark()
    vals = imp.toArray().tolist()
    rows = [(i, names[i] if i < len(names) else f"feature_{i}", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "slot int, feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), "slot")
    return df.limit(top_k) if top_k else df


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


# ---------------------------------------------------------------- long frames

def feature_long(df: DataFrame, id_col: str = "case_id", features: str = "features") -> DataFrame:
    """One row per (case, slot) with the feature value."""
    return df.select(id_col, F.posexplode(vector_to_array(features)).alias("slot", "value"))


def names_frame(names: list[str]) -> DataFrame:
    return _spark().createDataFrame(list(enumerate(names)), "slot int, feature string")


def linear_shap(df: DataFrame, coefficients: list[float], intercept: float, names: list[str],
                id_col: str = "case_id", features: str = "features") -> tuple[DataFrame, DataFrame]:
    """φ_j = β_j (x_j − mean_j) in log-odds; background = the explained rows.

    Returns ``(long frame, base frame)``; base = β₀ + Σ β_j mean_j.  The
    coefficient/name table has one row per feature (model-sized, broadcast).
    """
    spark = df.sparkSession
    coef = spark.createDataFrame([(i, names[i] if i < len(names) else f"feature_{i}", float(b))
                                  for i, b in enumerate(coefficients)], "slot int, feature string, coef double")
    long = feature_long(df, id_col, features)
    means = long.groupBy("slot").agg(F.avg("value").alias("mean"))
    params = F.broadcast(coef.join(means, "slot"))
    out = long.join(params, "slot").select(id_col, "slot", "feature", "value",
                                           (F.col("coef") * (F.col("value") - F.col("mean"))).alias("shap"))
    base = params.agg((F.lit(float(intercept)) + F.sum(F.col("coef") * F.col("mean"))).alias("base_value"))
    return out, base


def linear_shap_from_model(model, df: DataFrame, names: list[str], id_col: str = "case_id",
                           features: str = "features"):
    return linear_shap(df, model.coefficients.toArray().tolist(), float(model.intercept), names, id_col, features)


# ---------------------------------------------------------------- tree SHAP

def tree_nodes(model) -> tuple[list[dict], list[float], str]:
    """Nodes of a fitted tree ensemble from its saved node table.

    Returns ``(trees, weights, kind)``; each tree is a dict of numpy arrays
    indexed by node id.  ``kind`` is 'gbt' (explain log-odds = 2·Σ wₜ fₜ) or
    'forest' (explain P(class 1) = mean of leaf class shares).
    """
    spark = _spark()
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    kind = "gbt" if "GBT" in type(model).__name__ else "forest"
    if "treeID" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()   # model-sized
    else:
        rows = data.select(F.lit(0).alias("treeID"), "*").collect()
    weights = list(getattr(model, "treeWeights", None) or [1.0] * (max(r["treeID"] for r in rows) + 1))
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for t in sorted(by_tree):
        rs = sorted(by_tree[t], key=lambda r: r["id"])
        n = len(rs)
        tr = {k: np.zeros(n) for k in ("value", "cover", "threshold")}
        tr.update({k: np.full(n, -1, dtype=np.int64) for k in ("left", "right", "feature", "ncat")})
        tr["cats"] = [None] * n
        for r in rs:
            i = r["id"]
            stats = list(r["impurityStats"] or [])
            if kind == "gbt":
                tr["value"][i] = r["prediction"]
            else:
                s = sum(stats)
                tr["value"][i] = stats[1] / s if s > 0 and len(stats) > 1 else 0.0
            # weighted instance count: bootstrap weights make the raw count inconsistent
            if stats:
                tr["cover"][i] = stats[0] if kind == "gbt" else float(sum(stats))
            else:
                tr["cover"][i] = float(r["rawCount"] or 0)
            tr["left"][i], tr["right"][i] = r["leftChild"], r["rightChild"]
            sp = r["split"]
            tr["feature"][i] = sp["featureIndex"]
            tr["ncat"][i] = sp["numCategories"]
            vals = list(sp["leftCategoriesOrThreshold"] or [])
            if sp["numCategories"] >= 0:
                tr["cats"][i] = set(vals)
            elif vals:
                tr["threshold"][i] = vals[0]
        trees.append(tr)
    return trees, weights, kind


def _goes_left(tree, node, x):
    """Whether each row of ``x`` (features along the last axis) goes left at an inner node."""
    v = x[..., tree["feature"][node]]
    if tree["ncat"][node] >= 0:
        return np.isin(v, list(tree["cats"][node]))
    return v <= tree["threshold"][node]


def tree_expected_value(tree) -> float:
    leaves = tree["left"] < 0
    return float(np.sum(tree["value"][leaves] * tree["cover"][leaves]) / tree["cover"][0])


def _leaf_values(shares, met, value):
    """Shapley values of one leaf's features (columns) for patterns of met conditions (rows).

    The leaf is a game in which a feature taken from the row passes its
    conditions or not (``met``), and one not taken passes with its ``share`` of
    the training rows.  Coalitions of the other features are summed by their
    size: the coefficients of the product of ``share + met * t``.
    """
    m = len(shares)
    weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    out = np.empty(met.shape)
    for i in range(m):
        by_size = np.zeros(met.shape)
        by_size[:, 0] = 1.0
        for k in range(m):
            if k != i:
                taken = by_size[:, :-1] * met[:, k, None]
                by_size *= shares[k]
                by_size[:, 1:] += taken
        out[:, i] = value * (met[:, i] - shares[i]) * (by_size @ weight)
    return out


def _leaves(tree):
    """Leaves below a split: the inner nodes with their sides by feature, the shares, and a table of all patterns.

    A row's values at a leaf depend only on which features meet their conditions,
    so they are worked out once a pattern and looked up by the row's pattern.
    """
    out, todo = [], [(0, {})]
    while todo:
        j, path = todo.pop()
        if tree["left"][j] >= 0:
            d = int(tree["feature"][j])
            share, sides = path.get(d, (1.0, ()))
            for child, way in ((int(tree["left"][j]), True), (int(tree["right"][j]), False)):
                todo.append((child, {**path, d: (share * tree["cover"][child] / tree["cover"][j], (*sides, (j, way)))}))
        elif path:
            shares, m = np.array([share for share, _ in path.values()]), len(path)
            table = None
            if m <= TABLE_FEATURES:
                table = _leaf_values(shares, (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float), tree["value"][j])
            out.append(([(d, sides) for d, (_, sides) in path.items()], shares, tree["value"][j], table))
    return out


def tree_shap_batch(tree, x):
    """One tree's path-dependent SHAP values for every row of ``x`` (rows by features)."""
    if "leaves" not in tree:
        tree["leaves"] = _leaves(tree)
    phi = np.zeros(x.shape[::-1])
    went = {}
    for j in np.flatnonzero(tree["left"] >= 0):
        left = _goes_left(tree, j, x)
        went[j, True], went[j, False] = left, ~left
    for features, shares, value, table in tree["leaves"]:
        met = []
        for _, sides in features:
            one = went[sides[0]]
            for side in sides[1:]:
                one = one & went[side]
            met.append(one)
        if table is not None:
            pattern = met[0].astype(np.intp)
            for i, one in enumerate(met[1:], 1):
                pattern |= one.astype(np.intp) << i
            for i, (d, _) in enumerate(features):
                phi[d] += table[:, i][pattern]
        else:
            distinct, which = np.unique(np.array(met).T, axis=0, return_inverse=True)
            values = _leaf_values(shares, distinct.astype(float), value)[which.ravel()]
            for i, (d, _) in enumerate(features):
                phi[d] += values[:, i]
    return phi.T


def tree_shap(model, df: DataFrame, names: list[str], id_col: str = "case_id",
              features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Tree SHAP for a GBT (log-odds) or random forest (P(class 1)).

    Returns ``(long frame, base frame)`` with base + Σ shap = model output.
    """
    trees, weights, kind = tree_nodes(model)
    scale = 2.0 if kind == "gbt" else 1.0 / len(trees)
    tw = [w * scale for w in weights]
    base = float(sum(w * tree_expected_value(t) for w, t in zip(tw, trees)))
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((trees, tw))

    def explain(batches):
        trees_, tw_ = bc.value
        for pdf in batches:
            for a in range(0, len(pdf), SHAP_ROWS):
                x = np.asfortranarray(np.stack(pdf["x"].iloc[a:a + SHAP_ROWS].to_numpy()))
                phi = sum(w * tree_shap_batch(t, x) for w, t in zip(tw_, trees_))
                yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy()[a:a + SHAP_ROWS], x.shape[1]),
                                    "slot": np.tile(np.arange(x.shape[1], dtype=np.int32), len(x)),
                                    "value": x.ravel(), "shap": phi.ravel()})

    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(id_col, vector_to_array(features).alias("x"))
    tasks = max(-(-src.count() // TASK_ROWS), 1)
    if tasks > 1:
        src = src.repartition(max(tasks, spark.sparkContext.defaultParallelism))
    out = src.mapInPandas(explain, f"{id_col} {id_type}, slot int, value double, shap double")
    name = F.coalesce(F.col("feature"), F.concat(F.lit("feature_"), F.col("slot")))
    out = out.join(names_frame(names), "slot", "left").select(id_col, "slot", name.alias("feature"), "value", "shap")
    return out, spark.createDataFrame([(base,)], "base_value double")


# ---------------------------------------------------------------- rankings over the long frame

def shap_global(long: DataFrame, top_k: int | None = None) -> DataFrame:
    """Mean |SHAP| per feature, largest first."""
    g = long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")) \
        .orderBy(F.col("mean_abs_shap").desc(), "feature")
    return g.limit(top_k) if top_k else g


def shap_dependence(long: DataFrame, feature: str | None = None, id_col: str = "case_id") -> DataFrame:
    """(value, shap) pairs of one feature; default the globally top one."""
    if feature is None:
        feature = shap_global(long, 1).first()["feature"]
    return long.where(F.col("feature") == feature).select(id_col, "feature", "value", "shap")


def shap_describe(long: DataFrame, feature: str) -> DataFrame:
    """Descriptive statistics of one feature's SHAP values."""
    from caseflow.functions.quantiles import exact_quantiles
    s = long.where(F.col("feature") == feature)
    m = s.agg(F.count("shap").alias("count"), F.avg("shap").alias("mean"), F.stddev_samp("shap").alias("std"),
              F.min("shap").alias("min"), F.max("shap").alias("max"))
    q = exact_quantiles(s, "shap", [0.25, 0.5, 0.75], names=["p25", "p50", "p75"])
    return m.crossJoin(q).select(F.lit(feature).alias("feature"), "count", "mean", "std", "min",
                                 "p25", "p50", "p75", "max")


def shap_local(long: DataFrame, top_k: int = 15, id_col: str = "case_id") -> DataFrame:
    """Per case, the k features with the largest |SHAP| (all cases at once)."""
    w = Window.partitionBy(id_col).orderBy(F.abs("shap").desc(), F.col("slot"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def choose_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of the split to explain; unknown names are rejected."""
    if split not in ("train", "val", "test"):
        raise ValueError("split must be one of ['train', 'val', 'test']")
    return df.where(F.col("split") == split)

"""Tree SHAP against brute-force Shapley values and additivity on real models."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from caseflow.operators import explain as X
from caseflow.operators import models as M

from conftest import SF_SMALL


def _tree():
    # node 0: x0 <= 0.5 ? 1 : 2 ; node 1: x1 <= 0.5 ? 3 : 4 ; node 2: x0 <= 1.5 ? 5 : 6
    t = {"left": np.array([1, 3, 5, -1, -1, -1, -1]), "right": np.array([2, 4, 6, -1, -1, -1, -1]),
         "feature": np.array([0, 1, 0, -1, -1, -1, -1]), "ncat": np.full(7, -1),
         "threshold": np.array([0.5, 0.5, 1.5, 0, 0, 0, 0], dtype=float),
         "value": np.array([0, 0, 0, 1.0, 3.0, -2.0, 5.0]),
         "cover": np.array([10, 6, 4, 2, 4, 1, 3], dtype=float), "cats": [None] * 7}
    return t


def _cond_expect(t, x, S, j=0):
    if t["left"][j] < 0:
        return t["value"][j]
    f = t["feature"][j]
    l, r = t["left"][j], t["right"][j]
    if f in S:
        return _cond_expect(t, x, S, l if X._goes_left(t, j, x) else r)
    return (t["cover"][l] * _cond_expect(t, x, S, l) + t["cover"][r] * _cond_expect(t, x, S, r)) / t["cover"][j]


def test_tree_shap_matches_brute_force():
    t = _tree()
    n = 3
    for x in ([0.0, 0.0, 9.0], [1.0, 1.0, 0.0], [2.0, 0.0, 1.0]):
        x = np.array(x)
        phi = X.tree_shap_batch(t, x[None, :])[0]
        brute = np.zeros(n)
        for i in range(n):
            others = [k for k in range(n) if k != i]
            for size in range(n):
                for S in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    brute[i] += w * (_cond_expect(t, x, set(S) | {i}) - _cond_expect(t, x, set(S)))
        assert np.allclose(phi, brute, atol=1e-12)
        assert abs(X.tree_expected_value(t) + phi.sum() - _cond_expect(t, x, {0, 1, 2})) < 1e-12


def test_tree_shap_additive_on_gbt(spark):
    from caseflow.plans.catalog_models import LABEL, prepared, slot_names
    prep, frame = prepared(spark, SF_SMALL)
    model = M.fit(frame, "gbt", LABEL, n_estimators=5, max_depth=3)
    test = X.choose_split(frame, "test")
    long, base = X.tree_shap(model, test, slot_names(prep))
    b = base.first()[0]
    s = {r["case_id"]: r["s"] for r in long.groupBy("case_id").agg(F.sum("shap").alias("s")).collect()}
    for r in M.score(model, test).select("case_id", "score").collect():
        assert abs(b + s[r["case_id"]] - math.log(r["score"] / (1 - r["score"]))) < 1e-9


def test_tree_shap_additive_on_forest(spark):
    from caseflow.plans.catalog_models import LABEL, prepared, slot_names
    prep, frame = prepared(spark, SF_SMALL)
    model = M.fit(frame, "forest", LABEL, n_estimators=4, max_depth=6)
    test = X.choose_split(frame, "test")
    long, base = X.tree_shap(model, test, slot_names(prep))
    b = base.first()[0]
    s = {r["case_id"]: r["s"] for r in long.groupBy("case_id").agg(F.sum("shap").alias("s")).collect()}
    for r in M.score(model, test).select("case_id", "score").collect():
        assert abs(b + s[r["case_id"]] - r["score"]) < 1e-9


def test_choose_split_rejects_unknown(spark):
    import pytest
    df = spark.createDataFrame([("train",)], "split string")
    with pytest.raises(ValueError):
        X.choose_split(df, "holdout")

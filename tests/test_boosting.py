"""Boosted trees from binned cells against ``GBTClassifier``, and SHAP values of deep leaves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseflow.operators import boosting as B
from caseflow.operators import explain as X
from caseflow.operators import models as M

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def frame(spark):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 - 0.5 for i in range(3)]
    df = spark.range(3000).select("id", *[c.alias(f"x{i}") for i, c in enumerate(x)], (F.col("id") % 3 == 0).cast("double").alias("d"))
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < 2
    y = ((F.col("x0") + F.col("x1") * F.col("x2") + 0.2 * F.col("d") > 0.1) != noise).cast("int")
    return df.select("id", y.alias("y"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
                     array_to_vector(F.array("x0", "x1", "x2", "d")).alias("features")).cache()


def _scores(model, df):
    return np.array([r[0] for r in M.score(model, df).orderBy("id").select("score").collect()])


def test_cells_grow_the_trees_of_spark(spark, frame, monkeypatch):
    spark_model = M.fit(frame, "gbt", "y", n_estimators=6)
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    ours = M.fit(frame, "gbt", "y", n_estimators=6)
    assert ours.getNumTrees == 6 and type(ours) is type(spark_model)
    assert np.allclose(_scores(spark_model, frame), _scores(ours, frame), atol=1e-9)
    assert np.allclose(spark_model.featureImportances.toArray(), ours.featureImportances.toArray(), atol=1e-9)


def test_cells_stop_where_spark_stops(spark, frame):
    rows = frame.withColumn("_val", F.col("split") == "val")
    est = M.make_estimator("gbt", "y", n_estimators=30, learning_rate=0.3)
    est.setParams(validationIndicatorCol="_val", validationTol=0.0)
    binned = B.bin_rows(rows, "y", "features", F.col("_val"))
    assert binned.n_train == rows.where("not _val").count()
    assert B.boost(spark, binned, est, stop=True).getNumTrees == est.fit(rows.coalesce(1)).getNumTrees < 30


def test_copies_become_counts_and_blocks_do_not_matter(spark, frame, monkeypatch):
    train = frame.where("split = 'train'")
    est = M.make_estimator("gbt", "y", n_estimators=3, min_data_in_leaf=60)
    thrice = train.unionAll(train).unionAll(train)
    one, three = (B.bin_rows(t, "y", "features") for t in (train, thrice))
    assert one.n_cells == three.n_cells and three.n_train == 3 * one.n_train
    assert all(np.array_equal(a, b) for a, b in zip(one.points, three.points))
    a = B.boost(spark, three, est)
    monkeypatch.setattr(B, "CELLS", 300)
    monkeypatch.setattr(B, "CUT_EVERY", 2)
    b = B.boost(spark, three, est)
    assert np.array_equal(_scores(a, frame), _scores(b, frame))
    c = B.boost(spark, one, M.make_estimator("gbt", "y", n_estimators=3, min_data_in_leaf=20))
    assert np.allclose(_scores(a, frame), _scores(c, frame), atol=1e-9)


def test_row_samples_and_slot_subsets(spark, frame, monkeypatch):
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    a, b = (M.fit(frame, "gbt_sampled", "y", n_estimators=4) for _ in range(2))
    assert np.array_equal(_scores(a, frame), _scores(b, frame))
    trees = X.tree_nodes(a)[0]
    n = frame.where("split = 'train'").count()
    assert all(abs(t["cover"][0] / n - 0.8) < 0.05 for t in trees) and len({t["cover"][0] for t in trees}) > 1


def test_wrong_labels_are_an_error(spark, frame, monkeypatch):
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    with pytest.raises(Exception, match="must be 0 or 1"):
        M.fit(frame.withColumn("y", F.when(F.col("id") == 1, None).otherwise(F.col("y"))), "gbt", "y", n_estimators=1)


def test_leaf_tables_equal_distinct_patterns(monkeypatch):
    rng = np.random.default_rng(1)
    n = 9  # a chain: node i splits feature i, its left child is a leaf
    t = {"left": np.full(2 * n + 1, -1), "right": np.full(2 * n + 1, -1), "feature": np.full(2 * n + 1, -1),
         "ncat": np.full(2 * n + 1, -1), "threshold": np.full(2 * n + 1, 0.5), "value": rng.random(2 * n + 1),
         "cover": np.zeros(2 * n + 1), "cats": [None] * (2 * n + 1)}
    for i in range(n):
        t["left"][2 * i], t["right"][2 * i], t["feature"][2 * i] = 2 * i + 1, 2 * i + 2, i
        t["cover"][2 * i], t["cover"][2 * i + 1] = 2.0 ** (n - i), 2.0 ** (n - i - 1)
    t["cover"][2 * n] = 1.0
    x = rng.random((500, n))
    a = X.tree_shap_batch(dict(t), x)
    monkeypatch.setattr(X, "TABLE_FEATURES", 20)
    b = X.tree_shap_batch(dict(t), x)
    assert np.allclose(a, b, atol=1e-12)
    leaf = np.array([next((2 * i + 1 for i in range(n) if r[i] <= 0.5), 2 * n) for r in x])
    assert np.allclose(a.sum(axis=1) + X.tree_expected_value(t), t["value"][leaf], atol=1e-9)


def test_runs_cover_the_unlike_bins_and_only_smaller_siblings_are_counted(spark, frame, monkeypatch):
    binned = B.bin_rows(frame.where("split = 'train'"), "y", "features")
    blocks = B._blocks(spark, binned, False).collect()
    assert sum(int(b["n"].sum()) for b in blocks) == binned.n_train
    for b in blocks:
        assert sum(map(len, B._runs(b))) == len(b["flat"]) and list(b["runs"]) == sorted(b["runs"], reverse=True)
    seen = []
    best = B._best_splits

    def watch(h, tot, *rest):
        off, zero = rest[:2]
        sums = np.add.reduceat(h, off, axis=2)
        assert (h[:2] == np.rint(h[:2])).all() and (sums[0] <= tot[0][:, None]).all()  # what a parent leaves is whole counts
        seen.append(tot[0].sum())  # the open nodes of a level
        return best(h, tot, *rest)

    monkeypatch.setattr(B, "_best_splits", watch)
    B.boost(spark, binned, M.make_estimator("gbt", "y", n_estimators=2, min_data_in_leaf=1))
    assert seen[0] == seen[1] == binned.n_train


def test_split_cases_do_not_fold_the_events_again(spark):
    from caseflow.plans import catalog_models as Q
    _, cases = Q.prepared(spark, SF_SMALL)
    split = Q.split_cases(spark, SF_SMALL)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "Aggregate" not in plan and "Exchange" not in plan
    assert split.count() == cases.count()

"""Trees grown in one task: boosted trees against a job a level, and the forest against its definition and Spark's."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseflow.operators import boosting as B
from caseflow.operators import evaluate as E
from caseflow.operators import explain as X
from caseflow.operators import forests as R
from caseflow.operators import models as M


@pytest.fixture(scope="module")
def frame(spark):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 - 0.5 for i in range(3)]
    df = spark.range(3000).select("id", *[c.alias(f"x{i}") for i, c in enumerate(x)], (F.col("id") % 3 == 0).cast("double").alias("d"))
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < 2
    y = ((F.col("x0") + F.col("x1") * F.col("x2") + 0.2 * F.col("d") > 0.1) != noise).cast("int")
    return df.select("id", y.alias("y"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
                     array_to_vector(F.array("x0", "x1", "x2", "d")).alias("features")).cache()


@pytest.fixture(scope="module")
def binned(frame):
    return B.bin_rows(frame, "y", "features", F.col("split") == "val")


def _plain(growth):
    return [([(x["slot"], x["cut"], x["value"], x["left"], x["stats"][:2]) for x in nodes], w) for nodes, w in growth["forest"]]


@pytest.mark.parametrize("kind, stop, params", [("gbt", True, {"feature_fraction": 0.6}), ("gbt_symmetric", False, {"depth": 7, "iterations": 6})])
def test_one_task_grows_the_trees_of_a_job_a_level(spark, binned, monkeypatch, kind, stop, params):
    est = M.make_estimator(kind, "y", **{"n_estimators": 6, **params})
    alone = B.grow(spark, binned, est, stop)
    monkeypatch.setattr(B, "ALONE", 0)
    monkeypatch.setattr(B, "CELLS", 700)
    jobs = B.grow(spark, binned, est, stop)
    assert len(alone["forest"]) >= 4 and _plain(alone) == _plain(jobs) and alone["best"] == jobs["best"]
    squares = [[x["stats"][2] for nodes, _ in g["forest"] for x in nodes] for g in (alone, jobs)]
    assert np.allclose(*squares, rtol=1e-9)


@pytest.mark.parametrize("alone", [7, 0])
def test_more_rounds_go_on_where_fewer_ended(spark, binned, monkeypatch, alone):
    monkeypatch.setattr(B, "ALONE", alone)
    est = [M.make_estimator("gbt", "y", n_estimators=n, subsample=0.7, feature_fraction=0.5) for n in (3, 7)]
    assert est[0].getSubsamplingRate() == 0.7
    first = B.grow(spark, binned, est[0], True)
    assert _plain(B.grow(spark, binned, est[1], True, first)) == _plain(B.grow(spark, binned, est[1], True))


def test_a_fit_is_a_few_jobs_whatever_its_rounds(spark, frame, monkeypatch):
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    sc = spark.sparkContext

    def jobs(kind, **params):
        sc.setJobGroup(f"{kind}-{params}", "")
        M.fit(frame, kind, "y", binned=M.bin_train(frame, "y"), **params)
        return len(sc.statusTracker().getJobIdsForGroup(f"{kind}-{params}"))

    try:
        jobs("gbt", n_estimators=3), jobs("forest", n_estimators=2)  # the blank models
        assert jobs("gbt", n_estimators=40) <= jobs("gbt", n_estimators=4) + 2 < 60
        assert jobs("forest", n_estimators=30) <= jobs("forest", n_estimators=3) + 2 < 60
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_best_split_by_hand():
    rng = np.random.default_rng(3)
    points = [np.arange(4.0) - 1.5, np.array([0.5]), np.arange(6.0) + 0.5]
    off, zero, bins = B._layout(points)
    sizes = np.array([len(p) + 1 for p in points])
    codes = np.stack([rng.integers(0, s, 400) for s in sizes], axis=1)
    codes = codes[np.argsort(-(codes != zero).sum(axis=1), kind="stable")]
    runs = [[] for _ in sizes]
    for c in codes:
        for nth, f in enumerate(np.flatnonzero(c != zero)):
            runs[nth].append(off[f] + c[f])
    node, w = rng.integers(0, 5, 400), rng.integers(1, 4, 400).astype(float)
    w1 = w * (rng.random(400) < 0.4)
    tot = np.array([[w[node == k].sum(), w1[node == k].sum()] for k in range(5)])
    subset = R._subsets(rng, 5, 3, 2)
    assert all(len(set(s)) == 2 for s in subset)
    got = R._splits([np.array(r, np.int16) for r in runs], np.repeat(np.arange(3), sizes), off, sizes, zero, np.arange(400), node, w, w1,
                    tot, subset, 3)

    def gini(a, b):
        return 1 - ((a - b) / a) ** 2 - (b / a) ** 2

    for k in range(5):
        best = (0.0,)
        for f in subset[k]:
            for cut in range(sizes[f] - 1):
                mine = (node == k) & (codes[:, f] <= cut)
                n, n1 = w[mine].sum(), w1[mine].sum()
                if min(n, tot[k, 0] - n) >= 3:
                    gain = gini(*tot[k]) - n / tot[k, 0] * gini(n, n1) - (1 - n / tot[k, 0]) * gini(tot[k, 0] - n, tot[k, 1] - n1)
                    best = max(best, (gain, f, cut, n, n1))
        assert np.isclose(got[0][k], best[0]) and (got[1][k], got[2][k], *got[3][k]) == best[1:]


def test_forest_from_cells_is_like_sparks(spark, frame, monkeypatch):
    few = {"n_estimators": 20, "max_depth": 8}
    theirs = M.fit(frame, "forest", "y", **few)
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    ours, again = (M.fit(frame, "forest", "y", **few) for _ in range(2))
    assert type(ours) is type(theirs) is RandomForestClassificationModel and ours.getNumTrees == 20
    assert ours.numFeatures == theirs.numFeatures and ours.numClasses == 2 and ours.getMaxDepth() == 8
    assert abs(ours.totalNumNodes / theirs.totalNumNodes - 1) < 0.15
    val = frame.where("split = 'val'")
    a, b = (E.auc(M.score(m, val), y="y").first()["auc"] for m in (ours, theirs))
    assert abs(a - b) < 0.03 and np.abs(ours.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 0.08
    scores = [[r[0] for r in M.score(m, frame).orderBy("id").select("score").collect()] for m in (ours, again)]
    assert scores[0] == scores[1]
    # counts of a node are those of its children, and two leaves of one parent vote differently
    for t in X.tree_nodes(ours)[0]:
        inner = np.flatnonzero(t["left"] >= 0)
        left, right = t["left"][inner], t["right"][inner]
        assert np.allclose(t["cover"][inner], t["cover"][left] + t["cover"][right])
        assert abs(t["cover"][0] / frame.where("split = 'train'").count() - 1) < 0.1
        both = (t["left"][left] < 0) & (t["left"][right] < 0)
        assert both.any()
    assert ours.toDebugString.count("Predict") > 20


def test_trees_with_a_cell_for_each_node_and_chunks(spark, binned, frame, monkeypatch):
    """Unlimited depth, and nodes taken a few at a time: every leaf is pure, or its rows cannot be told apart."""
    est = M.make_estimator("forest", "y", n_estimators=1, max_features=1.0)
    off, zero, _ = B._layout(binned.points)
    p = {"off": off, "zero": zero, "sizes": np.array([len(x) + 1 for x in binned.points]), "depth": est.getMaxDepth(), "least": 1,
         "share": 4, "seed": 1, "rate": 1.0}
    block = B._blocks(spark, binned, False, 1).collect()[0]
    whole = R._tree(block, p, 0)
    monkeypatch.setattr(R, "ENTRIES", 12)  # all slots are drawn, so the chunks do not change the tree
    assert all(np.array_equal(a, b) for a, b in zip(whole, R._tree(block, p, 0)))
    tot, slot = whole[:2]
    leaf = slot < 0
    assert tot[leaf].sum(axis=0).tolist() == tot[0].tolist() and leaf.sum() > 200
    inner = np.flatnonzero(~leaf)
    a = whole[3][inner]
    vote = 2 * tot[:, 1] > tot[:, 0]
    assert not (leaf[a] & leaf[a + 1] & (vote[a] == vote[a + 1])).any()


def test_few_cells_or_empty_blocks(spark):
    df = spark.createDataFrame([(i, i % 2, "train", [float(i % 2)]) for i in range(40)], "id int, y int, split string, x array<double>")
    df = df.select("id", "y", "split", array_to_vector("x").alias("features"))
    b = B.bin_rows(df, "y", "features")
    m = R.fit(spark, b, M.make_estimator("forest", "y", n_estimators=3))
    assert m.totalNumNodes == 9 and M.score(m, df).where("pred = y").count() == 40
    one = R.fit(spark, B.bin_rows(df.where("y = 1"), "y", "features"), M.make_estimator("forest", "y", n_estimators=2))
    assert one.totalNumNodes == 2 and M.score(one, df).where("pred = 1").count() == 40

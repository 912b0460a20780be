"""Model settings, long boosting and the tuner on a small table."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseflow.operators import evaluate as E
from caseflow.operators import models as M


@pytest.fixture(scope="module")
def frame(spark):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(4)]
    df = spark.range(600).select("id", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < 2
    y = ((F.col("x0") + F.col("x1") * F.col("x2") > 0.8) != noise).cast("int")
    return df.select("id", y.alias("y"), F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train")
                     .alias("split"), array_to_vector(F.array("x0", "x1", "x2", "x3")).alias("features")).cache()


def test_depth_follows_leaves(spark):
    assert [M._depth(-1, n) for n in (2, 16, 31, 32, 33, 120)] == [1, 4, 5, 5, 6, 7]
    assert M._depth(3, 120) == 3 and M._depth(18, 16) == 4 and M._depth(None) == M.MAX_DEPTH
    assert M.make_estimator("gbt", "y").getMaxDepth() == 5
    assert M.make_estimator("gbt", "y").getMaxIter() == 300
    assert M.make_estimator("gbt_symmetric", "y").getMaxIter() == 1000
    assert M.make_estimator("forest", "y").getNumTrees() == 100


def test_long_boosting_cuts_its_lineage(frame):
    assert M.fit(frame, "gbt", "y", n_estimators=60, num_leaves=4).getNumTrees == 60


def test_tuner(frame):
    table, best, model = M.tune(frame, "y", explore=3, refine=4, rungs=(3, 6, 9), parallelism=2)
    rows = sorted(table.collect(), key=lambda r: r["trial"])
    assert [r["trial"] for r in rows] == list(range(7))
    assert [r["phase"] for r in rows] == ["explore"] * 3 + ["refine"] * 4
    for r in rows:
        assert all(lo <= r[k] <= hi for k, (lo, hi) in M.TUNE_RANGES.items())
        assert r["rounds"] <= (3, 6, 9)[r["rung"]] and r["stopped"] == (r["rounds"] < (3, 6, 9)[r["rung"]])
    # a third of the trials of a rung that would go on are on the next one
    open_ = [sum(r["rung"] > k or (r["rung"] == k and not r["stopped"]) for r in rows) for k in (0, 1)]
    assert [sum(r["rung"] > k for r in rows) for k in (0, 1)] == [-(-n // M.KEEP) for n in open_]
    assert best["val_log_loss"] == min(r["val_log_loss"] for r in rows)
    refit = E.log_loss(M.score(model, frame.where("split = 'val'")), y="y").first()["log_loss"]
    assert abs(refit - best["val_log_loss"]) < 1e-9 and model.getNumTrees == best["rounds"]
    again = M.tune(frame, "y", explore=3, refine=4, rungs=(3, 6, 9), parallelism=2)[1]
    assert again == best

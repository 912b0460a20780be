"""The tuner over cells, and what the model queries share."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseflow.operators import boosting as B
from caseflow.operators import evaluate as E
from caseflow.operators import models as M


def test_next_rung_goes_on_and_the_refit_is_the_trial(spark, monkeypatch):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(3)]
    df = spark.range(900).select("id", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < 2
    y = ((F.col("x0") + F.col("x1") * F.col("x2") > 0.8) != noise).cast("int")
    df = df.select("id", y.alias("y"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"),
                   array_to_vector(F.array("x0", "x1", "x2")).alias("features")).cache()
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    seen, grow = [], B.grow

    def watch(spark, binned, est, stop=False, growth=None):
        out = grow(spark, binned, est, stop, growth)
        seen.append((est.getMaxIter(), len(growth["forest"]) if growth else 0, stop))
        return out

    monkeypatch.setattr(B, "grow", watch)
    table, best, model = M.tune(df, "y", explore=3, refine=1, rungs=(3, 5, 8), parallelism=2)
    rows = table.collect()
    assert [s[1:] for s in seen[:4]] == [(0, True)] * 4 and seen[-1] == (best["rounds"], 0, False)  # the refit starts anew
    later = seen[4:-1]
    assert later and all((rounds, had) in ((5, 3), (8, 5)) for rounds, had, _ in later)
    assert len(rows) == 4 and best["val_log_loss"] == min(r["val_log_loss"] for r in rows)
    refit = E.log_loss(M.score(model, df.where("split = 'val'")), y="y").first()["log_loss"]
    assert abs(refit - best["val_log_loss"]) < 1e-9 and model.getNumTrees == best["rounds"]


def test_loading_a_model_wraps_no_tree(spark, monkeypatch):
    """PySpark lists params on each load and reads cached properties for that: ``trees`` wrapped every tree."""
    from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
    df = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), F.lit("train").alias("split"),
                                array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"))
    model = M.fit(df, "forest", "y", n_estimators=3)
    path = B.scratch_path(spark, "lazy")
    model.write().save(path)
    made, init = [], DecisionTreeClassificationModel.__init__
    monkeypatch.setattr(DecisionTreeClassificationModel, "__init__", lambda self, *a: (made.append(1), init(self, *a))[1])
    loaded = RandomForestClassificationModel.load(path)
    assert not made and loaded.getNumTrees == 3
    assert len(loaded.trees) == 3 and len(made) == 3

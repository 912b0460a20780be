"""Classifiers (M1–M9) as ``pyspark.ml`` estimators.

Parameter names of the reference's model wrappers are mapped onto Spark's
estimators; parameters without a Spark counterpart are ignored with a note
in the README.  Training always uses ``split = 'train'``; tuning scores on
``split = 'val'``.

Boosted trees limit leaves by depth: a tree of ``num_leaves`` leaves is grown
``ceil(log2(num_leaves))`` deep, or ``max_depth`` if that is less.  Up to ``SPARK_ROWS``
train rows ``GBTClassifier`` itself is fitted; it cuts its lineage every ten rounds in
the session's checkpoint folder, so hundreds of rounds neither overflow the scheduler's
stack nor start over when an executor is lost.  From more rows on the same trees are
grown from binned cells (``boosting``), and so are those of the forest (``forests``).
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from caseflow.operators import boosting, forests
from caseflow.operators.evaluate import log_loss
from caseflow.operators.prepare import SPLIT, class_weights
from caseflow.session import checkpoint_root

# PySpark lists a model's params whenever it wraps one, which skips properties, but reads a cached property:
# each of up to 1000 trees was wrapped, at some twenty calls to the JVM a tree, on every fit and load.
for _model in (GBTClassificationModel, RandomForestClassificationModel):
    if isinstance(_model.__dict__.get("trees"), cached_property):
        _model.trees = property(_model.__dict__["trees"].func)

# Presets of the boosted-tree variants and the tuning ranges.
MAX_DEPTH = 30
PRESETS = {
    "gbt": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": -1, "num_leaves": 31, "min_data_in_leaf": 20,
            "feature_fraction": 1.0},
    "gbt_sampled": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6, "subsample": 0.8,
                    "colsample_bytree": 0.8},
    "gbt_symmetric": {"iterations": 1000, "depth": 6, "learning_rate": 0.03},
    "forest": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1, "max_features": "sqrt"},
    "logit": {"max_iter": 500, "C": 1.0},
}
TUNE_RANGES = {"num_leaves": (16, 120), "max_depth": (3, 18), "learning_rate": (0.01, 0.3),
               "min_data_in_leaf": (5, 80), "feature_fraction": (0.5, 1.0)}


EXPLORE, REFINE = 8, 20  # trials drawn from the whole ranges, and around the best so far
ROUNDS = 300
RUNGS = (30, 100, ROUNDS)
KEEP = 3                 # one trial in so many goes on to the next rung
ROWS_PER_PARTITION = 50_000
SPARK_ROWS = 10_000      # Spark's trees take their split points from all rows up to here, and from a sample beyond


def _depth(d, leaves: int | None = None):
    """Depth for a limit of depth and leaves; unlimited is the deepest tree that Spark grows, more is an error."""
    if leaves is not None:
        by_leaves = max(1, (int(leaves) - 1).bit_length())
        return by_leaves if d is None or d < 0 else min(int(d), by_leaves)
    if d is None or d < 0:
        return MAX_DEPTH
    if d > MAX_DEPTH:
        raise ValueError(f"trees can be at most {MAX_DEPTH} deep, not {d}")
    return int(d)


def _fraction(f) -> str:
    if f is None or f == "auto":
        return "auto"
    if isinstance(f, str):
        return f
    return "all" if float(f) >= 1.0 else str(float(f))


def make_estimator(kind: str, label: str, features: str = "features", weight: str | None = None,
                   seed: int = 42, **params):
    """Estimator for ``kind`` ∈ {gbt, gbt_sampled, gbt_symmetric, forest, logit}."""
    p = {**PRESETS[kind], **params}
    common = {"featuresCol": features, "labelCol": label, "seed": seed}
    if weight:
        common["weightCol"] = weight
    if kind in ("gbt", "gbt_sampled"):
        est = GBTClassifier(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                            maxDepth=_depth(p.get("max_depth"), p.get("num_leaves")),
                            minInstancesPerNode=int(p.get("min_data_in_leaf", 1)),
                            subsamplingRate=float(p.get("subsample", 1.0)),
                            featureSubsetStrategy=_fraction(p.get("colsample_bytree", p.get("feature_fraction", 1.0))),
                            **common)
    elif kind == "gbt_symmetric":
        est = GBTClassifier(maxIter=int(p["iterations"]), maxDepth=_depth(p["depth"]),
                            stepSize=float(p["learning_rate"]), **common)
    elif kind == "forest":
        est = RandomForestClassifier(numTrees=int(p["n_estimators"]), maxDepth=_depth(p.get("max_depth")),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                     featureSubsetStrategy=_fraction(p.get("max_features", "sqrt")), **common)
    elif kind == "logit":
        common.pop("seed")
        est = LogisticRegression(maxIter=int(p["max_iter"]), elasticNetParam=0.0, standardization=False,
                                 regParam=float(p.get("reg_param", 0.0)), **common)
    else:
        raise ValueError(f"unknown model kind {kind}")
    return est


def l2_reg_param(C: float, n_train: int) -> float:
    """scikit-learn's ``C`` (sum of losses) → Spark's ``regParam`` (mean loss): 1/(C·n)."""
    return 1.0 / (C * max(n_train, 1))


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """Rows in as few partitions as their number asks for: every level of every tree is a job over them."""
    return rows.coalesce(max(1, -(-n // ROWS_PER_PARTITION)))


def bin_train(prepared: DataFrame, label: str, features: str = "features") -> boosting.Binned | None:
    """The cells of the train rows, if there are so many rows that trees are grown from cells."""
    train = prepared.where(F.col(SPLIT) == "train")
    return boosting.bin_rows(train, label, features) if train.count() > SPARK_ROWS else None


def fit(prepared: DataFrame, kind: str, label: str, features: str = "features", balanced: bool = False,
        binned: boosting.Binned | None = None, **params):
    """Model fitted on the train rows; ``balanced`` weighs each class by n / (k · n_class).

    ``binned``: the cells of the train rows, if they are already there.
    """
    spark = prepared.sparkSession
    checkpoint_root(spark)
    train = prepared.where(F.col(SPLIT) == "train")
    n = binned.n_train if binned else train.count()
    if balanced:
        params["weight"] = "_weight"
    if kind == "logit" and "reg_param" not in params:
        params["reg_param"] = l2_reg_param(params.get("C", PRESETS["logit"]["C"]), n)
    est = make_estimator(kind, label, features, **params)
    if isinstance(est, (GBTClassifier, RandomForestClassifier)) and n > SPARK_ROWS and not est.isSet(est.weightCol):
        binned = binned or boosting.bin_rows(train, label, features)
        if isinstance(est, GBTClassifier):
            return boosting.boost(spark, binned, est)
        if binned.n_cells <= forests.CELLS:
            return forests.fit(spark, binned, est)
    train = _sized(train, n)
    return est.fit(class_weights(train, label, "_weight") if balanced else train)


def score(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M8: probability of class 1 as ``score`` and ``pred = score ≥ threshold``."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("pred", (F.col("score") >= F.lit(threshold)).cast("int"))


def _fit_stopped(rows: DataFrame, label: str, features: str, rounds: int, params: dict, binned=None, growth=None):
    """Boosted trees on the train rows that end before the first round that does worse on val; from cells also their growth."""
    est = make_estimator("gbt", label, features, n_estimators=rounds, **params)
    est.setParams(validationIndicatorCol="_val", validationTol=0.0)
    if binned:
        growth = boosting.grow(rows.sparkSession, binned, est, True, growth)
        return boosting.as_model(rows.sparkSession, est, binned, growth, True), growth
    return est.fit(rows.withColumn("_val", F.col(SPLIT) == "val")), None


def _proposals(rng: random.Random, ranges: dict, n: int, around: dict | None = None) -> list[dict]:
    """Draws from the whole ranges, or normal steps of a fifth of each range from a good point, kept inside."""
    out = []
    for _ in range(n):
        t = {}
        for k, (lo, hi) in ranges.items():
            x = rng.uniform(lo, hi) if around is None else min(max(rng.gauss(around[k], (hi - lo) / 5), lo), hi)
            t[k] = int(x) if isinstance(lo, int) else float(x)
        out.append(t)
    return out


def tune(prepared: DataFrame, label: str, explore: int = EXPLORE, refine: int = REFINE, seed: int = 42,
         ranges: dict | None = None, rungs: tuple = RUNGS, parallelism: int = 4, features: str = "features"):
    """M9: search over the ranges with early stopping and successive halving, then a refit.

    ``explore`` trials come from the whole ranges, ``refine`` more from around the
    best so far, in batches of ``parallelism``.  A trial is a fit on train that stops
    when val gets worse; all trials get the first rung's rounds, and of those that
    would go on one in ``KEEP`` gets the next rung's.  The best parameters, with the
    rounds they used, are fitted again on the train rows.

    Returns the trial table (one row a trial: parameters, ``phase``, ``rung``,
    ``rounds``, ``stopped``, ``val_log_loss``), the best trial and the refit model.
    """
    checkpoint_root(prepared.sparkSession)
    ranges = ranges or TUNE_RANGES
    rng = random.Random(seed)
    rows = prepared.where(F.col(SPLIT).isin("train", "val"))
    n_train, n_rows = rows.select(F.count(F.when(F.col(SPLIT) == "train", 1)), F.count(F.lit(1))).first()
    binned = boosting.bin_rows(rows, label, features, F.col(SPLIT) == "val") if n_train > SPARK_ROWS else None
    rows = _sized(rows, n_rows)
    val = rows.where(F.col(SPLIT) == "val")
    done: list[dict] = []
    grown: dict = {}  # trial → its trees so far: from cells the next rung goes on where the last one ended

    def run(job):
        t, rung = job
        model, grown[t["trial"]] = _fit_stopped(rows, label, features, rungs[rung], {k: t[k] for k in ranges}, binned,
                                                grown.get(t["trial"]))
        loss = log_loss(score(model, val), y=label).first()["log_loss"]
        return {**t, "rung": rung, "rounds": model.getNumTrees, "stopped": model.getNumTrees < rungs[rung],
                "val_log_loss": float("inf") if loss is None else float(loss)}

    def rank(t):
        return t["val_log_loss"], t["trial"]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        def batch(points, phase):
            jobs = [({"trial": len(done) + i, "phase": phase, **p}, 0) for i, p in enumerate(points)]
            done.extend(pool.map(run, jobs))
        batch(_proposals(rng, ranges, explore), "explore")
        left = refine
        while left > 0:
            n = min(left, max(1, parallelism))
            best = min(done, key=rank) if done else None
            batch(_proposals(rng, ranges, n, best), "refine")
            left -= n
        for rung in range(1, len(rungs)):
            open_ = sorted((t for t in done if t["rung"] == rung - 1 and not t["stopped"]), key=rank)
            for t in pool.map(run, [({k: t[k] for k in ("trial", "phase", *ranges)}, rung)
                                    for t in open_[:-(-len(open_) // KEEP)]]):
                done[t["trial"]] = t
    best = min(done, key=rank)
    model = fit(prepared, "gbt", label, features, binned=binned, n_estimators=best["rounds"],
                **{k: best[k] for k in ranges})
    return prepared.sparkSession.createDataFrame(done), best, model

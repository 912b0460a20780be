
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.operators import evaluate as E
from caseflow.operators import prepare as D
from caseflow.operators import rankings as B
from caseflow.operators import sequence as W
from caseflow.operators.case_features import build_case_features
from caseflow.sources.fixtures import load_log

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def day(spark):
    return load_log(spark, SF_SMALL, "log_day")


def test_transition_and_dfg_counts(day):
    df, cols, _ = day
    n_events, n_cases = df.count(), df.select("case_id").distinct().count()
    enr = W.enrich(df, cols, with_prefix=False)
    assert enr.where("transition IS NOT NULL").count() == n_events - n_cases
    dfg_total = B.directly_follows(df, cols).agg(F.sum("n")).first()[0]
    assert dfg_total == n_events - n_cases


def test_last_prefix_is_final_trace(day):
    df, cols, _ = day
    enr = W.enrich(df, cols)
    last = enr.where("transition IS NULL").select("case_id", F.col("trace").alias("last_prefix"))
    final = B.case_traces(df, cols, with_lead=False)
    j = last.join(final, "case_id")
    assert j.count() == final.count()
    assert j.where("last_prefix <> trace").count() == 0


def test_rework_nonnegative(day):
    df, cols, sla = day
    c = build_case_features(df, sla, cols)
    assert c.where("rework_count < 0").count() == 0


def test_split_exact_disjoint_complete(day, spark):
    df, cols, sla = day
    cases = build_case_features(df, sla, cols)
    s = D.stratified_split(cases, "sla_violated", n_buckets=16)
    assert s.count() == cases.count() and s.select("case_id").distinct().count() == cases.count()
    got = {(r["sla_violated"], r["split"]): r["count"] for r in s.groupBy("sla_violated", "split").count().collect()}
    for y in (0, 1):
        n = cases.where(F.col("sla_violated") == y).count()
        nt = math.ceil(n * 0.2)
        nv = math.ceil((n - nt) * 0.25)
        assert got.get((y, "test"), 0) == nt and got.get((y, "val"), 0) == nv
        assert got.get((y, "train"), 0) == n - nt - nv
    # same members as a plain per-class ranking on md5('42:id')
    from pyspark.sql import Window
    w = Window.partitionBy("sla_violated").orderBy(F.md5(F.concat(F.lit("42:"), "case_id")), "case_id")
    plain = cases.withColumn("r", F.row_number().over(w) - 1).where("r < 10").select("case_id", "sla_violated")
    firsts = s.where("split = 'test'").select("case_id", "sla_violated")
    assert plain.exceptAll(firsts).count() == 0


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_and_complement(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300).tolist()
    s = np.round(rng.random(300), 2).tolist()
    df = spark.createDataFrame(list(zip(range(300), y, s)), "id long, y int, score double")
    a = E.auc(df).first()["auc"]
    assert abs(a - _auc_brute(y, s)) < 1e-12
    inv = df.withColumn("score", 1 - F.col("score"))
    assert abs(E.auc(inv).first()["auc"] - (1 - a)) < 1e-12
    one = df.withColumn("y", F.lit(1))
    assert E.auc(one).first()["auc"] is None


def test_report_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "id long, y int, score double")
    rep = {r["label"]: r for r in E.classification_report(E.predictions(df)).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["f1_score"] == 0.0
    assert rep["accuracy"]["f1_score"] == 0.5
    cm = {(r["y"], r["pred"]): r["n"] for r in E.confusion(E.predictions(df)).collect()}
    assert cm == {(0, 0): 1, (1, 0): 1, (0, 1): 0, (1, 1): 0}


def test_one_hot_unseen_is_zero(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([("a", "train", 1.0), ("b", "train", 2.0), ("c", "train", 3.0), ("z", "test", 4.0)],
                               "cat string, split string, x double")
    model, out = D.prepare_vectors(df, ["x"], ["cat"])
    vecs = {r["cat"]: r["features"].toArray().tolist() for r in out.collect()}
    assert vecs["a"] == [1.0, 1.0, 0.0, 0.0] and vecs["z"] == [4.0, 0.0, 0.0, 0.0]
    names = D.feature_names(df, ["x"], ["cat"]).orderBy("slot").collect()
    assert [r["name"] for r in names] == ["x", "cat=a", "cat=b", "cat=c"]
    assert Vectors is not None


def test_impute_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b", "train"), (2.0, "a", "train"), (4.0, "a", "train"), (7.0, "b", "train"),
                                (None, None, "test")], "x double, c string, split string")
    out = D.impute_categorical(D.impute_numeric(df, ["x"]), ["c"]).where("split = 'test'").first()
    assert out["x"] == 3.0 and out["c"] == "a"   # median of 1,2,4,7; smallest mode on a tie
    allnull = spark.createDataFrame([(None, "train")], "x double, split string")
    assert D.impute_numeric(allnull, ["x"]).first()["x"] == 0.0


def test_brute_force_itertools_available():
    assert list(itertools.combinations([1, 2, 3], 2))


def test_grouped_auc_equals_per_group(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 2)), float(np.round(rng.random(), 2)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, score double, g string")
    grouped = {r["g"]: r["auc"] for r in E.auc(df, keys=["g"]).collect()}
    for g in "ab":
        sub = [(y, s) for _, y, s, gg in rows if gg == g]
        assert abs(grouped[g] - _auc_brute([a for a, _ in sub], [b for _, b in sub])) < 1e-12

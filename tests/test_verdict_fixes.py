"""Rows that earlier versions lost or misread."""

import pytest
from pyspark.sql import functions as F

from caseflow.operators import contract as C
from caseflow.operators import evaluate as E
from caseflow.operators import models as M
from caseflow.operators import prepare as D
from caseflow.operators import rankings as R
from caseflow.sources import csv as CSV


def test_split_keeps_rows_without_label(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("case_id"),
                                F.when(F.col("id") >= 4, (F.col("id") % 2).cast("int")).alias("y"))
    out = D.stratified_split(df, "y")
    assert out.count() == 20 and out.where("y is null and split is not null").count() == 4


def test_missing_category_has_no_slot(spark):
    df = spark.createDataFrame([("1", "train", None), ("2", "train", "a"), ("3", "train", "b"), ("4", "test", None)],
                               "case_id string, split string, g string")
    assert sorted(map(tuple, D.category_slots(df, ["g"]).select("category", "slot").collect())) == [("a", 0), ("b", 1)]
    assert [r.name for r in D.feature_names(df, [], ["g"]).orderBy("slot").collect()] == ["g=a", "g=b"]


def test_variant_without_lead_time_stays(make_log):
    df = make_log([("C1", "A", "2023-01-01 09:00:00", "x", 1, None, "A"), ("C1", "B", "2023-01-02 09:00:00", "x", 2, None, "B"),
                   ("C2", "Z", None, "x", 1, None, "Z")])
    rows = {r.trace: r for r in R.trace_stats(df).collect()}
    assert len(rows) == 2 and sum(r.mean_lead_time is None for r in rows.values()) == 1


def test_roc_starts_at_the_origin(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, score double")
    points = {(r.threshold, r.fpr, r.tpr) for r in E.roc_points(df).collect()}
    assert points == {(float("inf"), 0.0, 0.0), (0.9, 0.0, 1.0), (0.1, 1.0, 1.0)}


def test_csv_is_read_by_header(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("Activity,CASE ID,cost,activity,note,timestamp\nGo,X1,nan,Other,n,2023-01-01 10:00:00\n")
    (r,) = CSV.read_event_csv(spark, str(path)).collect()
    assert (r.case_id, r.activity, r.resource, r.cost, r.timestamp.hour) == ("X1", "Go", None, None, 10)
    path = tmp_path / "day.csv"
    path.write_text("when;case_id\n31/12/2023 08:15;1\n31/12/2023 08:15:30;2\nbad;3\n")
    rows = CSV.read_dayfirst_csv(spark, str(path), "case_id int, when string", time_cols=("when",)).orderBy("case_id").collect()
    assert [r.when and (r.when.minute, r.when.second) for r in rows] == [(15, 0), (15, 30), None]


def test_roles_report_every_fit():
    roles = C.resolve_roles(["Time", "CaseID", "id caso", "Event", "x"])
    assert roles == {"case_id": ["id caso", "CaseID"], "activity": ["Event"], "timestamp": ["Time"]}


def test_role_clash_is_an_error(spark):
    df = spark.createDataFrame([("a", "b")], "case_id string, other string")
    with pytest.raises(ValueError):
        C.semantic_mapping(df, case="case_id", activity="case_id", timestamp="other")
    with pytest.raises(ValueError):
        C.semantic_mapping(df)


def test_too_deep_trees_are_an_error():
    with pytest.raises(ValueError):
        M._depth(31)
    assert M._depth(None) == M._depth(-1) == 30


def test_nan_is_missing_and_mode_takes_the_smallest_on_ties(spark):
    from caseflow.operators.profiling import describe_numeric
    df = spark.createDataFrame(
        [("train", 1.0, "b"), ("train", 3.0, "a"), ("train", float("nan"), "a"), ("train", None, "b"), ("val", float("nan"), None)],
        "split string, x double, c string")
    out = D.impute_categorical(D.impute_numeric(df, ["x"]), ["c"]).collect()
    assert sorted(r["x"] for r in out) == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert [r["c"] for r in out if r["split"] == "val"] == ["a"]
    d = describe_numeric(df, ["x"]).first()
    assert (d["count"], d["mean"], d["p50"], d["max"]) == (2, 2.0, 2.0, 3.0)


def test_balanced_fit_changes_the_scores(spark):
    from pyspark.ml.linalg import Vectors
    from caseflow.operators import models as M
    rows = [("train", float(i % 7 == 0), Vectors.dense([i % 5, i % 7])) for i in range(70)]
    df = spark.createDataFrame(rows, ["split", "y", "features"])
    plain = M.fit(df, "logit", "y", reg_param=1.0)
    even = M.fit(df, "logit", "y", balanced=True, reg_param=1.0)
    assert even.intercept > plain.intercept

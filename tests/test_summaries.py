"""Summaries from one count table: values, and that the input is read once."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from caseflow.functions.quantiles import exact_quantiles
from caseflow.operators import profiling as P

ROWS = [("a", 1.5), ("a", 1.5), ("a", -4.25), ("a", None), ("a", float("nan")), ("a", 1e9), ("b", 7.0), ("c", None),
        *[("h", float(i % 13)) for i in range(500)]]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "g string, x double").repartition(5)


def _expected(values):
    v = sorted(values)
    at = 0.5 * (len(v) - 1)
    median = v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at))
    return len(v), statistics.fmean(v), statistics.stdev(v) if len(v) > 1 else None, v[0], v[-1], median


@pytest.mark.parametrize("scale", [None, 2])
def test_moments_by_group(frame, scale):
    out = exact_quantiles(frame, "x", [0.5], ["g"], ["median"], partitions=3, moments=True, scale=scale)
    got = {r["g"]: tuple(r)[1:] for r in out.collect()}
    values = {g: [x for h, x in ROWS if h == g and x is not None and not math.isnan(x)] for g in "abh"}
    assert set(got) == set(values)
    for g, v in values.items():
        for x, y in zip(got[g], _expected(v)):
            assert x is None if y is None else x == pytest.approx(y, rel=1e-12)


def test_whole_table_and_no_rows(frame):
    assert exact_quantiles(frame, "x", [0.5], moments=True).first()["count"] == 505
    none = exact_quantiles(frame.where("g = 'c'"), "x", [0.5], moments=True).first()
    assert none["count"] == 0 and none["mean"] is None and none["std"] is None and none["q0"] is None


def test_describe_reads_its_input_once(spark, frame, tmp_path):
    path = f"file://{tmp_path}/t"
    frame.withColumn("y", F.lit(None).cast("double")).write.parquet(path)
    out = P.describe_numeric(spark.read.parquet(path), ["x", "y"])
    leaves = out._jdf.queryExecution().withCachedData().collectLeaves()
    names = [leaves.apply(i).nodeName() for i in range(leaves.size())]
    # the log is below the one count table only, nothing else scans it
    assert not [n for n in names if "parquet" in n.lower() or n == "LogicalRelation"] and "InMemoryRelation" in names
    rows = {r["column_name"]: r for r in out.collect()}
    assert rows["x"]["count"] == 505 and rows["y"]["count"] == 0 and rows["y"]["mean"] is None

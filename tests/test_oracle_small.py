"""Registered queries vs their DuckDB twins on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from caseflow.plans import registry
from conftest import SF_SMALL

import importlib.util

_spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts", "check_oracle.py"))
_chk = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_chk)

KEYS = ["late_transition_cost", "enrich_log", "label_boxplot", "label_deadline", "trace_stats", "variants", "dfg",
        "case_features", "quality_report", "contract_check", "stratified_split", "feature_names", "eval_auc",
        "eval_report_long", "shap_local", "read_xes_log"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in _chk.TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sp = E.queries()[key](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[key]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert _chk.rows(sp, 9) == _chk.rows(dd, 9)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["transition", "n", "mean_hours", "median_hours"]
    assert 0 < df.count() <= 5


def test_every_query_has_oracle_or_is_learned():
    E.queries()
    rows_only = set(registry.QUERIES) - set(registry.ORACLE)
    learned = {"prepare_vectors", "train_gbt", "train_gbt_sampled", "train_gbt_symmetric", "train_forest",
               "train_logit", "train_balanced", "score_cases",
               "model_comparison", "tune_random", "tune_refit", "model_roundtrip", "feature_importance", "shap_tree",
               "shap_linear_model"}
    assert rows_only <= learned

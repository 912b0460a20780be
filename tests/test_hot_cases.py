"""Hot-case chunking gives the same answers as one window per case."""

from pyspark.sql import functions as F

from caseflow.operators import rankings as B
from caseflow.operators import sequence as W
from caseflow.operators.nextevent import with_next_event
from caseflow.sources.fixtures import load_log

from conftest import SF_SMALL


def test_chunked_enrichment_equals_plain(spark):
    for name in ("log_user", "log_order"):
        df, cols, _ = load_log(spark, SF_SMALL, name)
        keys = ["case_id", "seq", *cols.tiebreak]
        plain = W.enrich(df, cols, with_prefix=False).select(*keys, "transition", "time_to_next", "lead_time")
        hot = W.enrich(df, cols, with_prefix=False, hot_case_rows=3) \
            .select(*keys, "transition", "time_to_next", "lead_time")
        assert plain.exceptAll(hot).count() == 0 and hot.exceptAll(plain).count() == 0


def test_chunked_dfg_equals_plain(spark):
    df, cols, _ = load_log(spark, SF_SMALL, "log_user")
    a = B.directly_follows(df, cols)
    b = B.directly_follows(df, cols, hot_case_rows=5)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_chunks_really_split(spark):
    df, cols, _ = load_log(spark, SF_SMALL, "log_user")
    plan = with_next_event(df, cols, hot_case_rows=5)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_no_hot_case_single_exchange(spark):
    df, cols, _ = load_log(spark, SF_SMALL, "log_day")
    plan = W.enrich(df, cols, with_prefix=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 1
    assert F is not None

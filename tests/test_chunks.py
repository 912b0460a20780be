"""Row-balanced chunks of long cases: brute force on bursts, equal times, nulls and one dominant case."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseflow.functions.roles import LogCols
from caseflow.operators import sequence as W
from caseflow.operators.nextevent import CHUNK_ROWS, chunk_borders, with_next_event

COLS = LogCols(case="c", timestamp="t", seq="s", status="v")
SCHEMA = "c string, t timestamp_ntz, s bigint, v string"
START = datetime(2024, 1, 1)


def _rows(kind, n=900):
    rng = random.Random(kind)
    rows = []
    for i in range(n):
        if kind == "equal":
            t = START
        elif kind == "burst":      # nearly all events within one microsecond of a year
            t = START + (timedelta(days=i) if i % 100 == 0 else timedelta(microseconds=rng.randrange(2)))
        else:
            t = None if rng.random() < .1 else START + timedelta(seconds=rng.randrange(500))
        rows.append(("hot", t, i, None if rng.random() < .2 else rng.choice("abc")))
    rows += [(f"k{i % 40}", START + timedelta(hours=rng.randrange(9)), n + i, "x") for i in range(120)]
    rows += [(None, START, 2 * n + i, "z") for i in range(30)]
    rng.shuffle(rows)
    return rows


def _expected(rows):
    """By seq (unique here): prefix, transition, days to next, lead days."""
    cases, out = {}, {}
    for r in rows:
        if r[0] is None:
            out[r[2]] = ([r[3]], None, None, None)
        else:
            cases.setdefault(r[0], []).append(r)
    day = timedelta(days=1)
    for events in cases.values():
        events.sort(key=lambda r: (r[1] is None, r[1] or START, r[2]))
        times = [r[1] for r in events if r[1]]
        seen = []
        for r, nxt in zip(events, events[1:] + [None]):
            seen = seen + [r[3]] * (r[3] is not None)
            step = None if nxt is None or None in (r[3], nxt[3]) else f"{r[3]} -> {nxt[3]}"
            gap = 0.0 if nxt is None else None if None in (r[1], nxt[1]) else (nxt[1] - r[1]) / day
            out[r[2]] = (seen, step, gap, (max(times) - min(times)) / day if times else None)
    return out


def _same(got, want):
    assert len(got) == len(want)
    for r in got:
        seen, step, gap, lead = want[r["s"]]
        if "trace_list" in r:
            assert r["trace_list"] == seen and r["trace"] == " -> ".join(seen)
        assert r["transition"] == step
        for x, y in ((r["time_to_next"], gap), (r["lead_time"], lead)):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9))


@pytest.mark.parametrize("kind", ["equal", "burst", "random"])
@pytest.mark.parametrize("size", [1, 50])
def test_chunks_equal_brute_force(spark, kind, size):
    rows = _rows(kind)
    df = spark.createDataFrame(rows, SCHEMA)
    _same(W.enrich(df, COLS, hot_case_rows=size).collect(), _expected(rows))


def test_single_columns_equal_brute_force(spark):
    rows = _rows("burst")
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.add_prefix_trace(W.add_transitions(df, COLS, hot_case_rows=50), COLS, hot_case_rows=50)
    out = W.add_lead_time(W.add_time_to_next(out, COLS, hot_case_rows=50), COLS, hot_case_rows=50)
    assert out.columns == ["c", "t", "s", "v", "transition", "trace_list", "trace", "time_to_next", "lead_time"]
    _same(out.collect(), _expected(rows))


@pytest.mark.parametrize("kind", ["equal", "burst"])
def test_chunks_hold_about_as_many_rows(spark, kind):
    df = spark.createDataFrame(_rows(kind, 20_000), SCHEMA)
    borders = chunk_borders(df, COLS, 1000).collect()
    assert [r["_of"] for r in borders] == ["hot"]
    at = sorted((x["v0"], x["v1"]) for x in borders[0]["_borders"])
    events = sorted((r[1], r[2]) for r in _rows(kind, 20_000) if r[0] == "hot")
    cuts = [0, *[sum(e < b for e in events) for b in at], len(events)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    assert 15 <= len(sizes) <= 25 and max(sizes) < 2000


def test_borders_are_bounded(spark):
    rows = _rows("random")
    df = spark.createDataFrame(rows, SCHEMA)
    n = lambda limit: chunk_borders(df, COLS, 2, limit).select(F.sum(F.size("_borders"))).first()[0]
    assert n(10_000) > 400 and 0 < n(10) <= 10
    got = with_next_event(df, COLS, carry=["v"], hot_case_rows=2, max_borders=10).where("c = 'hot'").collect()
    want = _expected(rows)
    for r in got:
        step = None if None in (r["v"], r["_nx_v"]) else f"{r['v']} -> {r['_nx_v']}"
        assert step == want[r["s"]][1]


def test_events_are_shuffled_once(spark):
    df = spark.createDataFrame(_rows("random"), SCHEMA)
    for size in (5, CHUNK_ROWS):
        out = W.enrich(df.withColumn("payload", F.concat("v", F.lit("!"))), COLS, with_prefix=False, hot_case_rows=size)
        plan = out._jdf.queryExecution().executedPlan()
        moved = [e for e in str(plan.toString()).split("\n") if "Exchange hashpartitioning(c#" in e]
        assert len(moved) == 1 and "_chunk" in moved[0]


def test_empty_log(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert W.enrich(df, COLS).count() == 0 and W.enrich(df, COLS, with_prefix=False, hot_case_rows=2).count() == 0


@pytest.mark.parametrize("kind", ["equal", "burst", "random"])
def test_trace_counts_equal_brute_force(spark, kind):
    from caseflow.operators import rankings as R
    rows = _rows(kind, 200)
    # each trace of the short cases twice, one of them with a null status in between
    rows += [(f"{r[0]}b", r[1], r[2] + 9000, r[3]) for r in rows if (r[0] or "").startswith("k")]
    rows += [("k0b", START + timedelta(days=2), 99_999, None), ("none", START, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    cases = {}
    for r in sorted((r for r in rows if r[0]), key=lambda r: (r[1] is None, r[1] or START, r[2])):
        cases.setdefault(r[0], []).append(r[3])
    want = {}
    for values in cases.values():
        text = " -> ".join(v for v in values if v is not None)
        want[text] = want.get(text, 0) + 1
    for size in (3, CHUNK_ROWS):
        got = R.final_trace_frequency(df, COLS, hot_case_rows=size)
        assert [tuple(r) for r in got.collect()] == sorted(want.items(), key=lambda x: (-x[1], x[0]))
    stats = R.trace_stats(df, COLS, top_n=None, hot_case_rows=3).collect()
    assert {r["trace"]: r["n_cases"] for r in stats} == want


def test_order_of_values_tells_traces_apart(spark):
    from caseflow.operators import rankings as R
    rows = [(c, START, i, v) for c, trace in (("1", "ab"), ("2", "ba"), ("3", "aab"), ("4", "aba"), ("5", "ab"), ("6", "aa"), ("7", ""))
            for i, v in enumerate(trace or [None])]
    marks = R.case_fingerprints(spark.createDataFrame(rows, SCHEMA), COLS, hot_case_rows=1).collect()
    by_case = {r["c"]: tuple(r[c] for c in R.FINGERPRINT) for r in marks}
    assert by_case["1"] == by_case["5"] and len(set(by_case.values())) == 6

"""Sketches against exact values, within their published bounds."""

import random
from datetime import date, timedelta

import pytest

from caseflow.functions import sketches as S
from caseflow.functions.quantiles import exact_quantiles

PROBS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 4}", date(2024, 1, 1) + timedelta(days=i % 20),
             None if i % 50 == 0 else rng.lognormvariate(0, 2), rng.randrange(4000)) for i in range(30_000)]
    rows += [("hot", date(2024, 1, 1), float("nan"), None), ("void", date(2024, 1, 1), None, 1)]
    return spark.createDataFrame(rows, "g string, d date, x double, u bigint").repartition(6), rows


def _rank_ok(values, x, p):
    below, upto = sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)
    return below - S.rank_error() <= p <= upto + S.rank_error()


def test_merged_days_within_bounds(events):
    df, rows = events
    days = S.daily_sketches(df, "d", ["g"], "x", "u")
    assert days.count() > 40
    got = S.read_sketches(S.merge_sketches(days, ["g"]), ["g"], PROBS).collect()
    assert len(got) == 6 - (1 if not any(r[0] == "g3" for r in rows) else 0)
    for r in got:
        values = [x for g, _, x, _ in rows if g == r["g"] and x is not None and x == x]
        seen = {u for g, _, _, u in rows if g == r["g"] and u is not None}
        assert r["n"] == len(values)
        assert abs(r["n_distinct"] - len(seen)) <= 4 * S.distinct_error() * len(seen) + 1
        for name, p in PROBS.items():
            assert r[name] is None if not values else _rank_ok(values, r[name], p)


def test_same_shape_as_exact(events):
    df, rows = events
    a = S.approx_quantiles(df, "x", [0.5, 0.9], ["g"], ["a", "b"], moments=True)
    e = exact_quantiles(df, "x", [0.5, 0.9], ["g"], ["a", "b"], moments=True)
    assert a.columns == e.columns
    exact = {r["g"]: r for r in e.collect()}
    got = {r["g"]: r for r in a.collect()}
    assert set(got) == set(exact)
    for g, r in got.items():
        assert all(r[c] == pytest.approx(exact[g][c], rel=1e-9) for c in ("count", "mean", "std", "min", "max"))
        values = [x for h, _, x, _ in rows if h == g and x is not None and x == x]
        assert _rank_ok(values, r["a"], 0.5) and _rank_ok(values, r["b"], 0.9)


def test_no_rows(events):
    df, _ = events
    none = df.where("g = 'nobody'")
    assert S.approx_quantiles(none, "x", [0.5], ["g"]).count() == 0
    assert S.approx_quantiles(none, "x", [0.5], moments=True).first()["q0"] is None
    assert S.merge_sketches(S.daily_sketches(none, "d", ["g"], "x", "u"), ["g"]).count() == 0

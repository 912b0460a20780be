"""Approximate quantiles and distinct counts from mergeable sketches.

The exact twins shuffle one row per distinct value of a group; a sketch is a few
kilobytes per group whatever the number of rows, so partial aggregates are all
that is moved.  Sketches kept per day can be merged into any longer span without
reading the events again.

*Quantiles* (KLL): the rank of the returned value differs from the one asked for
by at most ``rank_error(k)`` with 99 % confidence.  *Distinct counts* (HLL): the
relative standard error is ``distinct_error(lg_k)``.  Sketches are randomised, so
two runs may differ within these bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

K = 1024      # rank error 0.27 %
LG_K = 14     # relative standard error 0.81 %


def rank_error(k: int = K) -> float:
    """Published bound of the rank error of a single quantile."""
    return 2.296 / k ** 0.9723


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / math.sqrt(1 << lg_k)


def _number(value) -> Column:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(v), v)


def approx_quantiles(df: DataFrame, value, probs: list[float], by: list[str] | tuple = (),
                     names: list[str] | None = None, moments: bool = False, k: int = K) -> DataFrame:
    """Same columns as ``exact_quantiles``, in one aggregation; null and NaN are left out, groups without values too."""
    by = list(by)
    names = names or [f"q{i}" for i in range(len(probs))]
    rows = df.select(*by, _number(value).alias("_v")).where("_v is not null")
    aggs = [F.kll_sketch_agg_double("_v", k).alias("_s"), F.count("_v").alias("count")]
    if moments:
        aggs += [F.avg("_v").alias("mean"), F.when(F.count("_v") > 1, F.stddev_samp("_v")).alias("std"),
                 F.min("_v").alias("min"), F.max("_v").alias("max")]
    out = rows.groupBy(*by).agg(*aggs)
    picks = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(float(p)))).alias(name)
             for p, name in zip(probs, names)]
    return out.select(*by, *(["count", "mean", "std", "min", "max"] if moments else []), *picks)


def daily_sketches(df: DataFrame, day, by: list[str], value: str, distinct: str, k: int = K, lg_k: int = LG_K) -> DataFrame:
    """Per group and day: ``n`` values, their KLL sketch and an HLL sketch of ``distinct``; nulls are left out of both."""
    day = F.col(day) if isinstance(day, str) else day
    return df.select(*by, day.cast("date").alias("day"), _number(value).alias("_v"), F.col(distinct).alias("_d")) \
        .groupBy(*by, "day").agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", k).alias("quantiles"),
                                 F.hll_sketch_agg("_d", lg_k).alias("distinct"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The stored sketches of any days, one row per group; no event is read."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
                                     F.hll_union_agg("distinct").alias("distinct"))


def read_sketches(merged: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Estimates of merged sketches: ``n``, a column per probability and ``n_distinct``."""
    picks = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(name)
             for name, p in probs.items()]
    return merged.select(*by, "n", *picks, F.hll_sketch_estimate("distinct").alias("n_distinct"))

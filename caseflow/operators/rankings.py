"""Late-case, variant and transition rankings.

Whole-case rankings (final trace, variant) group cases by a fingerprint of
their trace: the xor of two 64-bit hashes of each (place, value), which partial
aggregates merge in any order, and the trace's length.  Only one case of each
trace is written out as text afterwards; strings never are shuffled to be counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from caseflow.functions.ordering import order_keys, order_struct
from caseflow.functions.quantiles import exact_quantiles
from caseflow.functions.roles import CANONICAL, LogCols
from caseflow.functions.timecols import micros_between, micros_to_days
from caseflow.operators.labels import LATE
from caseflow.operators.nextevent import CHUNK_ROWS, with_next_event, with_place
from caseflow.operators.sequence import SEP

N = "n"


def late_events(labelled: DataFrame, label_col: str = LATE) -> DataFrame:
    """B1: the events of late cases."""
    return labelled.where(F.col(label_col) == 1)


def late_kpis(labelled: DataFrame, cols: LogCols = CANONICAL, label_col: str = LATE) -> DataFrame:
    """B2: late cases and their mean / max / min lead time (days), one value per case."""
    per_case = (late_events(labelled, label_col).where(F.col(cols.case).isNotNull())
                .groupBy(cols.case)
                .agg(micros_between(F.min(cols.timestamp), F.max(cols.timestamp)).alias("lead_us")))
    return per_case.agg(
        F.count(F.lit(1)).alias("late_cases"),
        micros_to_days(F.avg("lead_us")).alias("mean_lead_time"),
        micros_to_days(F.max("lead_us")).alias("max_lead_time"),
        micros_to_days(F.min("lead_us")).alias("min_lead_time"),
    )


def frequency(df: DataFrame, column: str, count_name: str = N) -> DataFrame:
    """Value counts of a column, nulls dropped, most frequent first."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.col(count_name).desc(), F.col(column).asc()))


def case_traces(df: DataFrame, cols: LogCols = CANONICAL, value_col: str | None = None,
                sep: str = SEP, trace_name: str = "trace", with_lead: bool = True) -> DataFrame:
    """One row per case, for few cases: the whole ordered trace of ``value_col`` and its lead time (µs).

    Null values are skipped, as ``collect_list`` does for the prefix trace.
    """
    value_col = value_col or cols.status
    item = F.struct(order_struct(cols).alias("o"), F.col(value_col).alias("v"))
    aggs = [F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), sep)
            .alias(trace_name)]
    if with_lead:
        aggs.append(micros_between(F.min(cols.timestamp), F.max(cols.timestamp)).alias("lead_us"))
    return df.where(F.col(cols.case).isNotNull()).groupBy(cols.case).agg(*aggs)


FINGERPRINT = ["_mark_a", "_mark_b", "_length"]


def case_fingerprints(df: DataFrame, cols: LogCols = CANONICAL, value_col: str | None = None,
                      hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per case: ``FINGERPRINT`` of its trace of ``value_col`` (nulls skipped) and ``lead_us``.

    Cases share a fingerprint if they share the trace; different traces do with a chance of 2^-128 a pair.
    """
    value = F.col(value_col or cols.status)
    placed = with_place(df.where(F.col(cols.case).isNotNull()), cols, value_col or cols.status, "_place", hot_case_rows)
    marks = [F.when(value.isNotNull(), F.xxhash64("_place", value)),
             F.when(value.isNotNull(), F.xxhash64(F.lit("second"), value, "_place"))]
    return placed.groupBy(cols.case).agg(
        *[F.coalesce(F.bit_xor(m), F.lit(0)).alias(name) for m, name in zip(marks, FINGERPRINT)],
        F.count(value).alias("_length"),
        micros_between(F.min(cols.timestamp), F.max(cols.timestamp)).alias("lead_us"))


def trace_counts(df: DataFrame, cols: LogCols = CANONICAL, value_col: str | None = None, sep: str = SEP,
                 trace_name: str = "trace", count_name: str = N, hot_case_rows: int = CHUNK_ROWS,
                 mean_lead: bool = False) -> DataFrame:
    """One row per distinct trace: text, number of cases, ``FINGERPRINT`` (and mean lead time, µs)."""
    per_case = case_fingerprints(df, cols, value_col, hot_case_rows)
    aggs = [F.avg("lead_us").alias("mean_us")] if mean_lead else []
    kinds = per_case.groupBy(*FINGERPRINT).agg(F.count(F.lit(1)).alias(count_name),
                                               F.min(cols.case).alias("_sample"), *aggs)
    some = df.join(kinds.select(F.col("_sample").alias(cols.case)), cols.case, "left_semi")
    texts = case_traces(some, cols, value_col, sep, trace_name, with_lead=False)
    return kinds.join(texts, F.col("_sample") == F.col(cols.case)).drop("_sample", cols.case)


def final_trace_frequency(df: DataFrame, cols: LogCols = CANONICAL, hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    """How many cases end with each complete trace."""
    return trace_counts(df, cols, hot_case_rows=hot_case_rows).select("trace", N) \
        .orderBy(F.col(N).desc(), F.col("trace").asc())


def cases_per_value(df: DataFrame, attr: str, cols: LogCols = CANONICAL,
                    count_name: str = "n_cases") -> DataFrame:
    """Number of cases in which each (non-null) value of ``attr`` occurs."""
    pairs = df.where(F.col(cols.case).isNotNull() & F.col(attr).isNotNull()) \
        .select(cols.case, attr).distinct()
    return pairs.groupBy(attr).agg(F.count(F.lit(1)).alias(count_name)) \
        .orderBy(F.col(count_name).desc(), F.col(attr).asc())


def top_traces(df: DataFrame, cols: LogCols = CANONICAL, top_n: int = 30) -> DataFrame:
    """The N cases with the longest lead time, with their final trace (days)."""
    lead = micros_between(F.min(cols.timestamp), F.max(cols.timestamp))
    longest = df.where(F.col(cols.case).isNotNull()).groupBy(cols.case).agg(lead.alias("lead_us")) \
        .orderBy(F.col("lead_us").desc_nulls_last(), F.col(cols.case).asc()).limit(top_n)
    some = df.join(F.broadcast(longest.select(cols.case)), cols.case, "left_semi")  # top_n rows
    return (case_traces(some, cols)
            .select(F.col(cols.case).alias("case_id"), "trace", micros_to_days(F.col("lead_us")).alias("lead_time"))
            .orderBy(F.col("lead_time").desc_nulls_last(), F.col("case_id").asc()))


def top_transitions(enriched: DataFrame, cols: LogCols = CANONICAL, top_n: int = 30) -> DataFrame:
    """The N single transitions that took longest (days).

    Null times and null transitions are dropped before the cut, so exactly N
    rows come back when there are enough (the page drops null transitions
    after the cut; documented difference).
    """
    keys = [F.col("time_to_next").desc(), F.col(cols.case).asc()] + order_keys(cols)
    return (enriched.where(F.col("transition").isNotNull() & F.col("time_to_next").isNotNull())
                    .orderBy(*keys).limit(top_n)
                    .select(F.col(cols.case).alias("case_id"), "transition", "time_to_next"))


def trace_stats(df: DataFrame, cols: LogCols = CANONICAL, top_n: int | None = 30,
                digits: int | None = 6, hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per final trace (variant): cases, mean and median lead time (days)."""
    mean = micros_to_days(F.col("mean_us"))
    med = micros_to_days(F.col("_med"))
    if digits is not None:
        mean, med = F.round(mean, digits), F.round(med, digits)
    stats = trace_counts(df, cols, count_name="n_cases", hot_case_rows=hot_case_rows, mean_lead=True)
    meds = exact_quantiles(case_fingerprints(df, cols, hot_case_rows=hot_case_rows), "lead_us", [0.5], FINGERPRINT, ["_med"])
    # a variant none of whose cases has a lead time keeps its row, without mean and median
    out = (stats.join(meds, FINGERPRINT, "left")
                .select("trace", "n_cases", mean.alias("mean_lead_time"), med.alias("median_lead_time"))
                .orderBy(F.col("mean_lead_time").desc(), F.col("trace").asc()))
    return out.limit(top_n) if top_n else out


def transition_stats(enriched: DataFrame, top_n: int | None = 30, scale: float = 1.0,
                     time_col: str = "time_to_next", mean_name: str = "mean_time",
                     median_name: str = "median_time", digits: int | None = 6,
                     quantiles: Callable = exact_quantiles) -> DataFrame:
    """Per transition: count, mean and median time; top N by mean.

    ``scale`` converts the day unit (24.0 → hours).  Values are rounded to
    ``digits`` before ranking so that the cut is reproducible.  All three come
    from one pass; ``quantiles=approx_quantiles`` takes the median from a sketch.
    """
    v = enriched.where(F.col("transition").isNotNull())
    mean, med = F.col("mean") * F.lit(scale), F.col("_med") * F.lit(scale)
    if digits is not None:
        mean, med = F.round(mean, digits), F.round(med, digits)
    out = (quantiles(v, time_col, [0.5], ["transition"], ["_med"], moments=True)
           .select("transition", F.col("count").alias(N), mean.alias(mean_name), med.alias(median_name))
           .orderBy(F.col(mean_name).desc(), F.col("transition").asc()))
    return out.limit(top_n) if top_n else out


def variants(df: DataFrame, cols: LogCols = CANONICAL, top_n: int | None = 10,
             sep: str = " > ", hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    """variant = the case's activities joined by ``' > '``; counted."""
    out = trace_counts(df, cols, cols.activity, sep, "variant", hot_case_rows=hot_case_rows).select("variant", N) \
        .orderBy(F.col(N).desc(), F.col("variant").asc())
    return out.limit(top_n) if top_n else out


def directly_follows(df: DataFrame, cols: LogCols = CANONICAL, hot_case_rows: int | None = None) -> DataFrame:
    """Directly-follows graph — count of (activity, next activity) pairs.

    The next activity comes from the skew-safe next-event operator; the
    pair counts are map-side combined before their shuffle.
    """
    nx = with_next_event(df.where(F.col(cols.case).isNotNull()), cols, carry=[cols.activity],
                         hot_case_rows=hot_case_rows or CHUNK_ROWS, with_case_span=False)
    pairs = nx.select(F.col(cols.activity).alias("src"), F.col(f"_nx_{cols.activity}").alias("dst"))
    return (pairs.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
                 .groupBy("src", "dst").agg(F.count(F.lit(1)).alias(N))
                 .orderBy(F.col(N).desc(), "src", "dst"))


def round_cols(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})

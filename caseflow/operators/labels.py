"""Late-case labels (L1–L3) on the event log and case-table targets.

The event-level labels keep every row and add ``late`` (0/1) and ``delay``
(days beyond the limit, else 0).  All comparisons are strict ``>``; a missing
lead time or deadline compares false, so the label is 0.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from caseflow.functions.quantiles import exact_quantiles
from caseflow.functions.roles import CANONICAL, LogCols
from caseflow.functions.timecols import DAY_US, HOUR_US, micros_between, micros_to_days
from caseflow.operators.sequence import enrich

LATE = "late"
DELAY = "delay"


def _label_cols(late_cond: Column, excess_us: Column) -> dict[str, Column]:
    late = F.coalesce(late_cond, F.lit(False))
    delay = F.when(late, F.greatest(F.lit(0.0), micros_to_days(excess_us))).otherwise(F.lit(0.0))
    return {LATE: late.cast("int"), DELAY: delay}


def label_sla(df: DataFrame, sla_hours: float, cols: LogCols = CANONICAL,
              with_prefix: bool = True) -> DataFrame:
    """L1: late iff lead time > SLA.  No join: the lead time is a window column."""
    sla_us = F.lit(float(sla_hours) * HOUR_US)
    out = enrich(df, cols, with_prefix=with_prefix, keep_micros=True)
    lead = F.col("_lead_us")
    return out.withColumns(_label_cols(lead > sla_us, lead - sla_us)).drop("_next_us", "_lead_us")


def case_lead_micros(df: DataFrame, cols: LogCols = CANONICAL) -> DataFrame:
    """One row per (non-null) case with its lead time in microseconds."""
    return (df.where(F.col(cols.case).isNotNull())
              .groupBy(cols.case)
              .agg(micros_between(F.min(cols.timestamp), F.max(cols.timestamp)).alias("lead_us")))


def boxplot_fence(df: DataFrame, cols: LogCols = CANONICAL) -> DataFrame:
    """One row: Q1, Q3 and the upper fence Q3 + 1.5·IQR of case lead times (µs).

    Quartiles interpolate linearly (pandas ``quantile`` default = SQL
    ``quantile_cont``).  The result is exactly one row, so it is safe to
    broadcast.
    """
    q = exact_quantiles(case_lead_micros(df, cols), "lead_us", [0.25, 0.75], names=["q1_us", "q3_us"])
    return q.withColumn("fence_us", F.col("q3_us") + F.lit(1.5) * (F.col("q3_us") - F.col("q1_us")))


def label_boxplot(df: DataFrame, cols: LogCols = CANONICAL, with_prefix: bool = True) -> DataFrame:
    """L2: late iff lead time > box-plot fence; adds the fence (days) as ``fence``."""
    fence = boxplot_fence(df, cols).select("fence_us")
    out = enrich(df, cols, with_prefix=with_prefix, keep_micros=True).crossJoin(F.broadcast(fence))
    lead, lim = F.col("_lead_us"), F.col("fence_us")
    out = out.withColumns(_label_cols(lead > lim, lead - lim))
    return out.withColumn("fence", micros_to_days(lim)).drop("_next_us", "_lead_us", "fence_us")


def lenient_timestamp(col: Column, fmt: str | None = None) -> Column:
    """Text → TIMESTAMP_NTZ, unparsable → null."""
    parsed = F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)
    return parsed.cast("timestamp_ntz")


def _deadline_expr(df: DataFrame, cols: LogCols) -> Column:
    c = F.col(cols.deadline)
    if isinstance(df.schema[cols.deadline].dataType, StringType):
        return lenient_timestamp(c)
    return c.cast("timestamp_ntz")


def label_deadline(df: DataFrame, cols: LogCols = CANONICAL, with_prefix: bool = True) -> DataFrame:
    """L3: late iff the last event is after the (latest) desired end date.

    Both per-case maxima come from the enrichment's own partitioning (no
    extra shuffle); unparsable or missing deadlines compare false.
    """
    src = df.withColumn("_deadline", _deadline_expr(df, cols))
    out = enrich(src, cols, with_prefix=with_prefix, case_max=[cols.timestamp, "_deadline"])
    last_ts, last_dl = F.col(f"_cmax_{cols.timestamp}"), F.col("_cmax__deadline")
    has_case = F.col(cols.case).isNotNull()
    out = out.withColumns(_label_cols(has_case & (last_ts > last_dl), micros_between(last_dl, last_ts)))
    return out.drop("_deadline", f"_cmax_{cols.timestamp}", "_cmax__deadline")


# ---------------------------------------------------------------- case targets

TargetBuilder = Callable[[DataFrame], Mapping[str, Column]]


def sla_target(sla_hours: float, name: str = "sla_violated",
               throughput_col: str = "throughput_hours") -> TargetBuilder:
    """``throughput_hours > sla_hours`` as 0/1 (null throughput → 0)."""
    def build(cases: DataFrame) -> Mapping[str, Column]:
        cond = F.coalesce(F.col(throughput_col) > F.lit(float(sla_hours)), F.lit(False))
        return {name: cond.cast("int")}
    return build


def attribute_target(attr: str, threshold: float, name: str = "target") -> TargetBuilder:
    """Averaged attribute above a threshold (the attribute is dropped later)."""
    def build(cases: DataFrame) -> Mapping[str, Column]:
        return {name: F.coalesce(F.col(attr) > F.lit(float(threshold)), F.lit(False)).cast("int")}
    return build


def apply_target_builders(cases: DataFrame, builders: Iterable[TargetBuilder]) -> DataFrame:
    """Each builder maps the case table to named columns, appended in order."""
    for b in builders:
        produced = b(cases)
        if not isinstance(produced, Mapping) or not all(isinstance(v, Column) for v in produced.values()):
            raise TypeError("a target builder must return a mapping of name -> Column")
        cases = cases.withColumns(dict(produced))
    return cases


def above_median_target(cases: DataFrame, col: str = "throughput_hours",
                        name: str = "target") -> DataFrame:
    """1 iff the value is above the median over all cases.

    The median is a one-row aggregate joined by broadcast (size proven: 1 row).
    """
    med = exact_quantiles(cases, col, [0.5], names=["_median"])
    out = cases.crossJoin(F.broadcast(med))
    return out.withColumn(name, F.coalesce(F.col(col) > F.col("_median"), F.lit(False)).cast("int")) \
        .drop("_median")


def target_from_events(labelled: DataFrame, cols: LogCols = CANONICAL,
                       label_col: str = LATE, name: str = "target") -> DataFrame:
    """Carry an event-level label to one row per case (max over events)."""
    return (labelled.where(F.col(cols.case).isNotNull())
            .groupBy(F.col(cols.case).alias("case_id"))
            .agg(F.max(label_col).cast("int").alias(name)))


DAY_US = DAY_US

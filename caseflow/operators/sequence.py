"""Per-event sequence columns (W1–W8) over one shared window.

All columns come from the next-event operator, whose window runs per chunk of a
case in the order ``(time, seq, ties…)``: the enrichment shuffles the events
once and sorts them once, and no task needs a whole case.

Rows whose case id is null get no transition, time or lead time (pandas drops
null group keys); Spark would group them together, so those columns are
blanked with ``when(case IS NOT NULL)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.ordering import order_keys
from caseflow.functions.roles import CANONICAL, LogCols
from caseflow.functions.timecols import micros_between, micros_to_days
from caseflow.operators.nextevent import CHUNK_ROWS, with_next_event

SEP = " -> "


def _has_case(cols: LogCols) -> Column:
    return F.col(cols.case).isNotNull()


def prefix_text_col(list_col: Column, sep: str = SEP) -> Column:
    """The prefix list joined by ``' -> '``."""
    return F.array_join(list_col, sep)


def _transition(cols: LogCols, sep: str = SEP) -> Column:
    """``status -> next status``; null on the last event of a case."""
    return F.when(_has_case(cols), F.concat(F.col(cols.status), F.lit(sep), F.col(f"_nx_{cols.status}")))


def _next_micros(cols: LogCols) -> Column:
    """W4 in microseconds: 0 on the last event, null if a time is missing."""
    gap = micros_between(F.col(cols.timestamp), F.col(f"_nx_{cols.timestamp}"))
    return F.when(~_has_case(cols), F.lit(None).cast("bigint")) \
        .when(~F.col("_has_next"), F.lit(0).cast("bigint")).otherwise(gap)


def _lead_micros(cols: LogCols) -> Column:
    """W5 in microseconds: max − min time of the case, on every event."""
    return F.when(_has_case(cols), micros_between(F.col("_case_min"), F.col("_case_max")))


def _prefix_list(cols: LogCols) -> Column:
    """Statuses seen so far in the case (the status column, not activity)."""
    return F.when(_has_case(cols), F.col("_prefix")).otherwise(F.array_compact(F.array(F.col(cols.status))))


def _drop_helpers(df: DataFrame, cols: LogCols) -> DataFrame:
    return df.drop(f"_nx_{cols.status}", f"_nx_{cols.timestamp}", "_has_next", "_case_min", "_case_max", "_prefix")


def add_prefix_trace(df: DataFrame, cols: LogCols = CANONICAL, list_name: str = "trace_list",
                     text_name: str = "trace", hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    """The prefix as list and as text; each task holds the prefixes of one chunk of a case."""
    out = with_next_event(df, cols, carry=[], with_case_span=False, prefix=cols.status, hot_case_rows=hot_case_rows)
    out = _drop_helpers(out.withColumn(list_name, _prefix_list(cols)), cols)
    return out.withColumn(text_name, prefix_text_col(F.col(list_name)))


def add_transitions(df: DataFrame, cols: LogCols = CANONICAL, name: str = "transition",
                    hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    out = with_next_event(df, cols, carry=[cols.status], with_case_span=False, hot_case_rows=hot_case_rows)
    return _drop_helpers(out.withColumn(name, _transition(cols)), cols)


def add_time_to_next(df: DataFrame, cols: LogCols = CANONICAL, name: str = "time_to_next",
                     hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    out = with_next_event(df, cols, carry=[cols.timestamp], with_case_span=False, hot_case_rows=hot_case_rows)
    return _drop_helpers(out.withColumn(name, micros_to_days(_next_micros(cols))), cols)


def add_lead_time(df: DataFrame, cols: LogCols = CANONICAL, name: str = "lead_time",
                  hot_case_rows: int = CHUNK_ROWS) -> DataFrame:
    out = with_next_event(df, cols, carry=[], hot_case_rows=hot_case_rows)
    return _drop_helpers(out.withColumn(name, micros_to_days(_lead_micros(cols))), cols)


def enrich(df: DataFrame, cols: LogCols = CANONICAL, with_prefix: bool = True,
           keep_micros: bool = False, hot_case_rows: int | None = None,
           case_max: list[str] | None = None) -> DataFrame:
    """Prefix trace, transition, time to next event and lead time in one pass.

    ``with_prefix=False`` skips the prefix list, whose size is quadratic in
    the case length; rankings over whole cases never need prefixes.  Cases
    of more than ``hot_case_rows`` events are cut into chunks of about that size.
    ``case_max`` columns get their per-case maximum as ``_cmax_<c>``.
    """
    out = with_next_event(df, cols, carry=[cols.status, cols.timestamp], hot_case_rows=hot_case_rows or CHUNK_ROWS,
                          case_max=case_max, prefix=cols.status if with_prefix else None)
    new = {"transition": _transition(cols), "_next_us": _next_micros(cols), "_lead_us": _lead_micros(cols)}
    if with_prefix:
        new["trace_list"] = _prefix_list(cols)
    out = _drop_helpers(out.withColumns(new), cols)
    if with_prefix:
        out = out.withColumn("trace", prefix_text_col(F.col("trace_list")))
    out = out.withColumns({"time_to_next": micros_to_days(F.col("_next_us")),
                           "lead_time": micros_to_days(F.col("_lead_us"))})
    return out if keep_micros else out.drop("_next_us", "_lead_us")


def sort_events(df: DataFrame, cols: LogCols = CANONICAL) -> DataFrame:
    """The event order as a global sort — only for exports and previews."""
    return df.orderBy(F.col(cols.case).asc_nulls_last(), *order_keys(cols))

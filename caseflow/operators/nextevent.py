"""Skew-safe "next event in the case" for transitions, gaps, prefixes and the DFG.

A plain ``lead() over partitionBy(case)`` sends a whole case to one task.
Here a long case is cut into chunks of about ``hot_case_rows`` events and the
window runs per ``(case, chunk)``:

1. a hash sample of the events (``SAMPLED`` of each ``hot_case_rows``) is numbered
   per case in event order; every ``SAMPLED``-th key is a border.  Cases of fewer
   events have none.  Borders are whole order keys, so bursts and equal times are
   cut as evenly as anything else; only events that tie in every order column
   stay together;
2. beyond ``MAX_BORDERS`` borders every 2nd, 3rd… of a case is kept, so the table
   of borders that is broadcast is bounded whatever the size of the log;
3. an event's chunk is the number of its case's borders that do not sort after
   it, found by bisection.  The chunks of a case are contiguous in event order;
4. a table of one row per chunk of the cut cases carries values over the borders:
   the next chunk's first event, the time span and the maxima of the case.

Everything is lazy and the events are shuffled once, by ``(case, chunk)``.  If no
case has a border, adaptive execution drops the joins with the empty tables.
Events without a case are spread over many chunks, as they get no values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseflow.functions.ordering import order_keys, order_struct
from caseflow.functions.roles import CANONICAL, LogCols

CHUNK_ROWS = 5_000_000
SAMPLED = 64              # sampled events of a chunk
MAX_BORDERS = 1 << 16
HASH_SPAN = 1 << 40
SPREAD = 1 << 12          # chunks of the events without a case


def chunk_borders(df: DataFrame, cols: LogCols, hot_case_rows: int = CHUNK_ROWS,
                  max_borders: int = MAX_BORDERS) -> DataFrame:
    """``_of, _borders``: per long case the sorted order keys at which its chunks start, ``max_borders`` in all at most."""
    rate = min(1.0, SAMPLED / hot_case_rows)
    stride = max(1, round(hot_case_rows * rate))
    drawn = F.pmod(F.xxhash64(cols.case, *cols.order_columns()), F.lit(HASH_SPAN)) < int(rate * HASH_SPAN)
    sample = df.where(F.col(cols.case).isNotNull() & drawn).select(
        F.col(cols.case).alias("_of"), order_struct(cols).alias("_at"))
    place = F.row_number().over(Window.partitionBy("_of").orderBy("_at"))
    # about one row per hot_case_rows events from here on
    marks = sample.withColumn("_place", place).where(F.col("_place") % stride == 0)
    thin = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / F.lit(max_borders))
    return (marks.withColumn("_thin", thin).where(F.col("_place") % (F.col("_thin") * stride) == 0)
                 .groupBy("_of").agg(F.array_sort(F.collect_set("_at")).alias("_borders")))


def _chunk_of(cols: LogCols) -> Column:
    """How many of ``_borders`` do not sort after the event."""
    at = order_struct(cols)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_BORDERS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        F.get(F.col("_borders"), n + step - 1) <= at, n + step).otherwise(n))


def _in_chunks(df: DataFrame, cols: LogCols, hot_case_rows: int, max_borders: int) -> tuple[DataFrame, DataFrame]:
    """Events of the cut cases with ``_of, _in`` (case, chunk), and all events with ``_chunk``."""
    case = F.col(cols.case)
    borders = F.broadcast(chunk_borders(df, cols, hot_case_rows, max_borders))
    chunk = (F.when(case.isNull(), F.pmod(F.xxhash64(*cols.order_columns()), F.lit(SPREAD)).cast("int"))
              .when(F.col("_borders").isNull(), F.lit(0)).otherwise(_chunk_of(cols)))
    cut = df.join(borders, case == F.col("_of")).withColumn("_in", _chunk_of(cols))
    return cut, df.join(borders, case == F.col("_of"), "left").withColumn("_chunk", chunk).drop("_of", "_borders")


def with_place(df: DataFrame, cols: LogCols, value: str, name: str = "_place",
               hot_case_rows: int = CHUNK_ROWS, max_borders: int = MAX_BORDERS) -> DataFrame:
    """Add the event's place (1, 2…) among those of its case that have a ``value``; null for the others."""
    cut, out = _in_chunks(df, cols, hot_case_rows, max_borders)
    before = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut.groupBy("_of", "_in").agg(F.count(value).alias("_n")).select(
        "_of", "_in", F.sum("_n").over(before).alias("_before"))
    here = Window.partitionBy(cols.case, "_chunk").orderBy(*order_keys(cols)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_here", F.count(value).over(here))
    # at most two rows per border
    out = out.join(F.broadcast(chunks), (F.col(cols.case) == F.col("_of")) & (F.col("_chunk") == F.col("_in")), "left")
    place = F.coalesce("_before", F.lit(0)) + F.col("_here")
    return out.withColumn(name, F.when(F.col(value).isNotNull() & F.col(cols.case).isNotNull(), place)) \
        .drop("_of", "_in", "_chunk", "_before", "_here")


def with_next_event(df: DataFrame, cols: LogCols = CANONICAL, carry: list[str] | None = None,
                    hot_case_rows: int = CHUNK_ROWS, with_case_span: bool = True,
                    case_max: list[str] | None = None, prefix: str | None = None,
                    max_borders: int = MAX_BORDERS) -> DataFrame:
    """Add ``_nx_<c>`` (next event's value of each carried column) and ``_has_next``;
    with ``with_case_span`` also ``_case_min``/``_case_max`` (case time span),
    for ``case_max`` columns their per-case maximum as ``_cmax_<c>``, and for
    ``prefix`` its non-null values up to the event as ``_prefix``.

    Events without a case get nulls.
    """
    case_max = list(case_max or [])
    case, ts = cols.case, cols.timestamp
    carry = list(dict.fromkeys([cols.status] if carry is None else carry))
    cut, out = _in_chunks(df, cols, hot_case_rows, max_borders)
    first = F.min(F.struct(order_struct(cols).alias("o"), *[F.col(c).alias(c) for c in carry]))
    chunks = cut.groupBy("_of", "_in").agg(
        first.alias("_first"), F.min(ts).alias("_mn"), F.max(ts).alias("_mx"),
        *[F.max(c).alias(f"_hm_{c}") for c in case_max])
    whole = Window.partitionBy("_of")
    chunks = chunks.select(
        "_of", "_in", F.lead("_first").over(whole.orderBy("_in")).alias("_next_first"),
        F.min("_mn").over(whole).alias("_mn"), F.max("_mx").over(whole).alias("_mx"),
        *[F.max(f"_hm_{c}").over(whole).alias(f"_hm_{c}") for c in case_max])

    part = Window.partitionBy(case, "_chunk")
    order = part.orderBy(*order_keys(cols))
    local = {f"_lx_{c}": F.lead(c).over(order) for c in carry}
    local["_local_next"] = F.lead(F.lit(1)).over(order).isNotNull()
    if with_case_span:
        local["_wmin"], local["_wmax"] = F.min(ts).over(part), F.max(ts).over(part)
    for c in case_max:
        local[f"_wm_{c}"] = F.max(c).over(part)
    if prefix:
        local["_lp"] = F.collect_list(prefix).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumns(local)

    # at most two rows per border
    same = (F.col(case) == F.col("_of")) & (F.col("_chunk") == F.col("_in"))
    out = out.join(F.broadcast(chunks), same, "left").drop("_of", "_in")
    new = {f"_nx_{c}": F.when(F.col("_local_next"), F.col(f"_lx_{c}")).otherwise(F.col("_next_first")[c]) for c in carry}
    new["_has_next"] = F.col("_local_next") | F.col("_next_first").isNotNull()
    if with_case_span:
        new["_case_min"], new["_case_max"] = F.coalesce("_mn", "_wmin"), F.coalesce("_mx", "_wmax")
    for c in case_max:
        new[f"_cmax_{c}"] = F.coalesce(f"_hm_{c}", f"_wm_{c}")
    if prefix:
        # as long as the prefixes themselves, hence joined by the window's own key and not broadcast
        out = out.join(_earlier(cut, cols, prefix), same, "left").drop("_of", "_in")
        new["_prefix"] = F.concat(F.coalesce("_earlier", F.array().cast(out.schema["_lp"].dataType)), "_lp")
    out = out.withColumns({k: F.when(F.col(case).isNotNull(), v) for k, v in new.items()})
    return out.drop("_chunk", "_local_next", "_next_first", "_wmin", "_wmax", "_mn", "_mx", "_lp", "_earlier",
                    *[f"_lx_{c}" for c in carry], *[f"{p}{c}" for c in case_max for p in ("_wm_", "_hm_")])


def _earlier(cut: DataFrame, cols: LogCols, prefix: str) -> DataFrame:
    """Per chunk of a cut case the values of its earlier chunks, in event order."""
    item = F.struct(order_struct(cols).alias("o"), F.col(prefix).alias("v"))
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col(prefix).isNotNull(), item))), lambda x: x["v"])
    before = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    return cut.groupBy("_of", "_in").agg(values.alias("_v")).select(
        "_of", "_in", F.flatten(F.collect_list("_v").over(before)).alias("_earlier"))

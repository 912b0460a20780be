"""Log profiling (P1–P11): KPIs, column quality, descriptive statistics.

Per-column statistics are computed in long form: the columns are unpivoted
to ``(column_name, value)`` and aggregated with one ``groupBy`` — one data
shuffle (map-side combined) instead of one pass or one ``Expand`` copy per
column.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType,
                               IntegerType, LongType, NumericType, ShortType, ByteType, StringType,
                               TimestampNTZType, TimestampType)

from caseflow.functions.quantiles import exact_quantiles
from caseflow.functions.roles import CANONICAL, LogCols
from caseflow.functions.timecols import micros_between, micros_to_hours


def sql_type_name(t: DataType) -> str:
    """Spark type → the SQL-standard name (as DuckDB's ``typeof`` prints it)."""
    table = {StringType: "VARCHAR", LongType: "BIGINT", IntegerType: "INTEGER", ShortType: "SMALLINT",
             ByteType: "TINYINT", DoubleType: "DOUBLE", FloatType: "FLOAT", BooleanType: "BOOLEAN",
             DateType: "DATE", TimestampNTZType: "TIMESTAMP", TimestampType: "TIMESTAMP WITH TIME ZONE"}
    for k, v in table.items():
        if isinstance(t, k):
            return v
    if isinstance(t, DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return t.simpleString().upper()


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """P5: numeric columns by type; booleans and timestamps count as categorical."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def log_kpis(df: DataFrame, cols: LogCols = CANONICAL) -> DataFrame:
    """Events, distinct cases, distinct activities, first and last day."""
    return df.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct(cols.case).alias("n_cases"),
        F.count_distinct(cols.activity).alias("n_activities"),
        F.date_format(F.min(cols.timestamp), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(cols.timestamp), "yyyy-MM-dd").alias("last_day"),
    )


def log_overview(df: DataFrame, cols: LogCols = CANONICAL) -> DataFrame:
    """Events, cases, activities and resources."""
    aggs = [F.count(F.lit(1)).alias("n_events"),
            F.count_distinct(cols.case).alias("n_cases"),
            F.count_distinct(cols.activity).alias("n_activities")]
    if cols.resource and cols.resource in df.columns:
        aggs.append(F.count_distinct(cols.resource).alias("n_resources"))
    else:
        aggs.append(F.lit(0).cast("bigint").alias("n_resources"))
    return df.agg(*aggs)


def _long(df: DataFrame, columns: list[str], cast: str) -> DataFrame:
    wide = df.select(*[F.col(c).cast(cast).alias(c) for c in columns])
    if cast == "double":  # a NaN counts as missing
        wide = wide.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "value")


def quality_report(df: DataFrame) -> DataFrame:
    """Per column type, nulls, % nulls (2 dp) and distinct non-null values.

    Sorted by % nulls, then distinct count (both descending), then name.
    """
    columns = df.columns
    types = df.sparkSession.createDataFrame(
        [(c, sql_type_name(df.schema[c].dataType)) for c in columns], "column_name string, type string")
    per_value = _long(df, columns, "string").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    per_col = per_value.groupBy("column_name").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("n_unique"))
    out = per_col.join(F.broadcast(types), "column_name")  # one row per column: bounded
    out = out.select("column_name", "type", F.col("nulls").cast("bigint").alias("nulls"),
                     F.round(F.col("nulls") * 100.0 / F.col("n"), 2).alias("pct_nulls"), "n_unique")
    return out.orderBy(F.col("pct_nulls").desc(), F.col("n_unique").desc(), F.col("column_name"))


def quality_risks(df: DataFrame, cols: LogCols = CANONICAL, bad_time_share: float = 0.01,
                  time_format: str | None = None) -> DataFrame:
    """Risk checklist — > 1 % bad timestamps, null case ids, events without activity."""
    ts = F.col(cols.timestamp)
    if isinstance(df.schema[cols.timestamp].dataType, StringType):
        ts = F.try_to_timestamp(ts, F.lit(time_format)) if time_format else F.try_to_timestamp(ts)
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(ts.isNull()).alias("bad_time"),
                 F.count_if(F.col(cols.case).isNull()).alias("null_case"),
                 F.count_if(F.col(cols.activity).isNull()).alias("null_activity"))
    rows = agg.select(F.explode(F.array(
        F.struct(F.lit("bad_timestamps").alias("risk"), F.col("bad_time").alias("n_bad"),
                 (F.col("bad_time") > F.col("n") * F.lit(bad_time_share)).alias("flag")),
        F.struct(F.lit("null_case_id").alias("risk"), F.col("null_case").alias("n_bad"),
                 (F.col("null_case") > 0).alias("flag")),
        F.struct(F.lit("null_activity").alias("risk"), F.col("null_activity").alias("n_bad"),
                 (F.col("null_activity") > 0).alias("flag")),
    )).alias("r")).select("r.*")
    return rows.select("risk", "n_bad", F.coalesce("flag", F.lit(False)).cast("int").alias("flagged"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """Count, mean, std (n−1), min, quartiles (linear), max per numeric column.

    With ``scale``, values have that many decimals and are summed exactly.
    """
    columns = columns or numeric_columns(df)
    out = exact_quantiles(_long(df, columns, "double"), "value", [0.25, 0.5, 0.75], ["column_name"], ["p25", "p50", "p75"],
                          moments=True, scale=scale)
    # a column without values has a row as well
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(out, "column_name", "left").select(
        "column_name", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def case_throughput_hours(df: DataFrame, cols: LogCols = CANONICAL) -> DataFrame:
    return (df.where(F.col(cols.case).isNotNull()).groupBy(cols.case)
              .agg(micros_to_hours(micros_between(F.min(cols.timestamp), F.max(cols.timestamp)))
                   .alias("throughput_hours")))


def throughput_describe(df: DataFrame, cols: LogCols = CANONICAL, quantiles: Callable = exact_quantiles) -> DataFrame:
    """Distribution of case throughput (hours) with the 50/90/95 % points, from sketches with ``approx_quantiles``."""
    out = quantiles(case_throughput_hours(df, cols), "throughput_hours", [0.5, 0.9, 0.95], names=["p50", "p90", "p95"],
                          moments=True)
    return out.select(F.col("count").alias("n_cases"), "mean", "std", "min", "p50", "p90", "p95", "max")


def boxplot_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whisker fences (1.5·IQR) and outlier count per column."""
    columns = columns or numeric_columns(df)
    long = _long(df, columns, "double")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column_name"], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
        .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))
    # one row per column: the fence table is bounded by the column count
    flagged = long.join(F.broadcast(q.select("column_name", "lower_fence", "upper_fence")), "column_name")
    outl = flagged.groupBy("column_name").agg(F.count_if(
        (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))).alias("n_outliers"))
    return q.join(outl, "column_name")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair (long form, both orders and the diagonal)."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    aggs = [F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    aggs.append(F.lit(1).alias("_one"))
    one = df.agg(*aggs)
    items = []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            items.append(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"c{i}").alias("corr")))
    for c in columns:
        items.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("corr")))
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """P10: rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def attribute_values(df: DataFrame, attr: str) -> DataFrame:
    """Values of an event attribute with their counts (nulls dropped)."""
    return df.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), F.col(attr))

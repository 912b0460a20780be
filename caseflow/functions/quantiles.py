"""Exact quantiles (linear interpolation) without a per-group single task.

Spark's ``percentile`` keeps every distinct value of a group in one task's
memory, so a hot group (one column over the whole table, one dominant
transition) is bounded by a single executor.  Here the work is spread:

1. ``(group, value) → count``: map-side combined, duplicates collapse;
2. that table is range-partitioned on ``(group, value)`` so one group spans
   as many tasks as its distinct values need, and persisted so that both
   uses below see the same partitioning (a lost block is recomputed from the
   same shuffle, hence lands in the same partition);
3. running counts per ``(group, partition)`` plus the totals of earlier
   partitions of the group (a table of ≤ groups + partitions rows) give the
   cumulative count of every value;
4. the value at 0-based rank r is ``min(value) where cum > r``; the result is
   ``lo + (hi − lo)·frac`` at position ``p·(n − 1)`` — pandas' and SQL
   ``quantile_cont``'s rule.

Counts, sums, squares and extremes come from the same tables, so a summary of a
column reads its input once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F


def exact_quantiles(df: DataFrame, value, probs: list[float], by: list[str] | tuple = (),
                    names: list[str] | None = None, partitions: int | None = None,
                    moments: bool = False, scale: int | None = None) -> DataFrame:
    """One row per group (or one row) with a double column per probability; null and NaN are left out.

    ``moments`` adds ``count, mean, std`` (n − 1), ``min`` and ``max``; with
    ``scale`` values have that many decimals and are summed exactly.  The squares
    are taken around the mean, which the totals give before.
    """
    by = list(by)
    names = names or [f"q{i}" for i in range(len(probs))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")) \
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n_part = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(n_part, *by, "_v") \
        .withColumn("_p", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)

    total = F.sum(F.col("_v") * F.col("_c")) if scale is None else F.sum(
        F.col("_v").cast(f"decimal(28,{scale})") * F.col("_c").cast("decimal(18,0)"))
    chunks = ranged.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"), total.alias("_t"))
    grp = Window.partitionBy(*by) if by else Window.partitionBy()
    chunks = chunks.withColumns({
        "_off": F.coalesce(F.sum("_s").over(grp.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_n": F.sum("_s").over(grp),
        "_mean": F.sum("_t").over(grp).cast("double") / F.sum("_s").over(grp),
    }).drop("_s", "_t")
    run = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ranged.withColumn("_cum", F.sum("_c").over(run)).join(chunks, by + ["_p"]) \
        .withColumn("_cum", F.col("_cum") + F.col("_off"))

    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col("_v"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_cum") > hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.max(pos - lo).alias(f"_f{i}")]
    outs = []
    if moments:
        aggs += [F.max("_n").alias("_count"), F.max("_mean").alias("_mu"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                 F.sum(F.col("_c") * (F.col("_v") - F.col("_mean")) * (F.col("_v") - F.col("_mean"))).alias("_ss")]
        outs += [F.coalesce("_count", F.lit(0)).cast("bigint").alias("count"), F.col("_mu").alias("mean"),
                 F.when(F.col("_count") > 1, F.sqrt(F.col("_ss") / (F.col("_count") - 1))).alias("std"),
                 F.col("_min").alias("min"), F.col("_max").alias("max")]
    res = cum.groupBy(*by).agg(*aggs)
    for i, name in enumerate(names):
        lo, hi, fr = F.col(f"_lo{i}"), F.coalesce(F.col(f"_hi{i}"), F.col(f"_lo{i}")), F.col(f"_f{i}")
        outs.append(F.when(fr == 0, lo).otherwise(lo + (hi - lo) * fr).alias(name))
    return res.select(*by, *outs)

"""Global row numbers without a single task.

Rows are range-partitioned and sorted by the whole order, so partition i holds
what sorts before partition i + 1.  A row's number is its place inside the
partition plus the rows of earlier partitions, a table of one row a partition.
The ordered rows are written once, because range bounds come from a sample and
a recomputed stage must not deal rows out differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PLACE_BITS = 33  # monotonically_increasing_id: partition above, place within it below


def number_rows(df: DataFrame, order: list[Column], path: str, name: str = "row_no",
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3… in the given order; the ordered rows lie below ``path``.

    Rows that tie in the whole order share a partition and are numbered in any
    order, so ``order`` should name enough columns to tell most rows apart.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({
        "_part": F.shiftright(at, PLACE_BITS).cast("int"),
        "_place": at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
    })
    ranged.write.mode("overwrite").parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a partition
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1) \
        .drop("_part", "_place", "_before")

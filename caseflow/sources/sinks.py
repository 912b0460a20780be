"""Sinks (S4–S6): Parquet/CSV export, model persistence, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseflow.functions.ordering import order_keys
from caseflow.functions.roles import CANONICAL, LogCols


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Columnar export (the default); optionally partitioned for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def roundtrip_parquet(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    write_parquet(df, path)
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """Persist any fitted ``pyspark.ml`` stage or pipeline."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def preview(df: DataFrame, cols: LogCols = CANONICAL, n: int = 200) -> DataFrame:
    """The first ``n`` events in total event order (a top-k, not a full sort)."""
    return df.orderBy(F.col(cols.case).asc_nulls_last(), *order_keys(cols)).limit(n)

"""CSV event logs (S1, S2) with an explicit schema — never ``inferSchema``."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from caseflow.operators.contract import header_key, source_names

CANONICAL_SCHEMA = ("case_id string, activity string, timestamp string, resource string, cost double")
RICH_SCHEMA = ("case_id string, activity string, timestamp string, seq bigint, status string, "
               "resource string, cost double, deadline string, group_code string, priority string, "
               "purpose_code string, intervention_type string")


def file_headers(spark: SparkSession, path: str | list[str], sep: str = ",") -> dict[tuple, list[str]]:
    """The header of every file below ``path``: files by header.

    A file's header is its first line that is not blank.  One pass over the lines
    with an aggregate per file; a row a file reaches the driver, which lists the
    files anyway.  Files without a line are left out.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at")).where("start = 0 and length(trim(value)) > 0")
    found: dict[tuple, list[str]] = {}
    for r in sorted(lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()):
        header = next(csv.reader([r["line"].removeprefix("\ufeff")], delimiter=sep))
        found.setdefault(tuple(header), []).append(unquote(r["file"]))  # file_path is URL-encoded
    return found


def _pick(raw: DataFrame, header: tuple, target: StructType) -> DataFrame:
    """The schema's columns from text columns in the order of a header."""
    known, place = source_names(list(header)), {}
    for i, h in enumerate(header):
        place.setdefault(header_key(h), i)
    for i, h in enumerate(header):
        if h in known:
            place.setdefault(header_key(known[h]), i)
    out = []
    for f in target.fields:
        i = place.get(header_key(f.name))
        value = F.lit(None) if i is None else F.col(f"_c{i}")
        if i is not None and isinstance(f.dataType, (DoubleType, FloatType)):
            value = F.when(F.lower(F.trim(value)) != "nan", value)
        out.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*out)


def _read_by_name(spark: SparkSession, path: str | list[str], schema: str | StructType, sep: str, mode: str) -> DataFrame:
    """Read all columns as text in file order, then pick and cast the schema's columns by header name.

    Files are read together by header, each with its own order of columns.  A
    header matches by its key (see ``header_key``) or as a known source name; of
    duplicate headers the first counts.  Columns the schema lacks are left out,
    columns a file lacks are null.  NaN is read as missing.
    """
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    out = None
    for header, files in file_headers(spark, path, sep).items():
        text = StructType([StructField(f"_c{i}", StringType()) for i in range(len(header))])
        raw = spark.read.schema(text).option("header", True).option("sep", sep).option("mode", mode).csv(files)
        part = _pick(raw, header, target)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], target) if out is None else out


def read_event_csv(spark: SparkSession, path: str | list[str], schema: str | StructType = CANONICAL_SCHEMA,
                   sep: str = ",", time_cols=("timestamp",), time_format: str | None = None,
                   strict: bool = True) -> DataFrame:
    """Read a headered CSV log; parse the time columns to TIMESTAMP_NTZ.

    ``strict`` (the pipeline's reader) fails on unparsable times (C6);
    otherwise they become null (C7).  CRLF line ends are handled by the reader.
    """
    df = _read_by_name(spark, path, schema, sep, "FAILFAST")
    conv = {}
    for c in time_cols:
        if c in df.columns:
            if strict:
                conv[c] = F.to_timestamp_ntz(F.col(c), F.lit(time_format)) if time_format else F.to_timestamp_ntz(F.col(c))
            else:
                p = F.try_to_timestamp(F.col(c), F.lit(time_format)) if time_format else F.try_to_timestamp(F.col(c))
                conv[c] = p.cast("timestamp_ntz")
    return df.withColumns(conv) if conv else df


def read_dayfirst_csv(spark: SparkSession, path: str | list[str], schema: str | StructType,
                      time_cols=("timestamp",), sep: str = ";") -> DataFrame:
    """``;``-separated, day-first dates (``dd/MM/yyyy HH:mm[:ss]``); bad → null."""
    df = _read_by_name(spark, path, schema, sep, "PERMISSIVE")
    conv = {}
    for c in time_cols:
        full = F.try_to_timestamp(F.col(c), F.lit("dd/MM/yyyy HH:mm:ss"))
        short = F.try_to_timestamp(F.col(c), F.lit("dd/MM/yyyy HH:mm"))
        conv[c] = F.coalesce(full, short).cast("timestamp_ntz")
    return df.withColumns(conv)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite",
              timestamp_format: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> None:
    """S4 (CSV form): a directory of part files with a header each."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
       .option("timestampNTZFormat", timestamp_format).csv(path))

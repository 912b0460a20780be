"""XES event logs (S3) through Spark's built-in XML source.

A trace is one XML row (``rowTag=trace``); its events are an array of
structs whose typed attribute lists (``string``, ``date``, ``int``, ``float``,
``boolean``) hold ``key``/``value`` pairs.  The schema is given explicitly
because the reader infers a struct for one attribute and an array for many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_KV = ArrayType(StructType([StructField("_key", StringType()), StructField("_value", StringType())]))
_EVENT = StructType([StructField(t, _KV) for t in ("string", "date", "int", "float", "boolean")])
XES_SCHEMA = StructType([
    StructField("string", _KV),
    StructField("event", ArrayType(_EVENT)),
])

# The XES standard attribute keys mapped to canonical names.
XES_KEYS = {"case": "concept:name", "activity": "concept:name", "resource": "org:resource",
            "timestamp": "time:timestamp"}


def _kv_map(col):
    return F.map_from_entries(F.transform(F.coalesce(col, F.array()), lambda kv: F.struct(kv["_key"], kv["_value"])))


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Flatten an XES file to ``case_id, activity, timestamp, resource``.

    Times keep their offset when parsed and are then stored as UTC wall time
    (TIMESTAMP_NTZ) — the session time zone must be UTC.
    """
    raw = spark.read.format("xml").option("rowTag", "trace").schema(XES_SCHEMA).load(path)
    tr = raw.select(_kv_map(F.col("string"))[XES_KEYS["case"]].alias("case_id"),
                    F.explode_outer("event").alias("e"))
    attrs = _kv_map(F.col("e.string"))
    dates = _kv_map(F.col("e.date"))
    ts = F.to_timestamp(dates[XES_KEYS["timestamp"]])
    return tr.select("case_id", attrs[XES_KEYS["activity"]].alias("activity"),
                     F.to_utc_timestamp(ts, "UTC").cast("timestamp_ntz").alias("timestamp"),
                     attrs[XES_KEYS["resource"]].alias("resource"))


def write_xes(df: DataFrame, path: str, case: str = "case_id", activity: str = "activity",
              timestamp: str = "timestamp", resource: str = "resource", order: list[str] | None = None) -> None:
    """Write an event table as XES: one ``<trace>`` per case, events in time order.

    The trace row is by definition the whole case (that is the XES layout).
    """
    order = order or [timestamp]
    ev = F.struct(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)],
        F.array(F.struct(F.lit(XES_KEYS["activity"]).alias("_key"), F.col(activity).alias("_value")),
                F.struct(F.lit(XES_KEYS["resource"]).alias("_key"), F.col(resource).alias("_value")))
        .alias("string"),
        F.array(F.struct(F.lit(XES_KEYS["timestamp"]).alias("_key"),
                         F.date_format(F.col(timestamp), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
                         .alias("_value"))).alias("date"))
    traces = df.groupBy(case).agg(F.array_sort(F.collect_list(ev)).alias("ev"))
    out = traces.select(
        F.array(F.struct(F.lit(XES_KEYS["case"]).alias("_key"), F.col(case).cast("string").alias("_value")))
        .alias("string"),
        F.transform("ev", lambda e: F.struct(e["string"].alias("string"), e["date"].alias("date"))).alias("event"))
    out.write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)

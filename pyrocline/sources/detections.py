"""Detections: CSV scans, parsed locations, and a fixture over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyrocline.functions.geometry import point_part

SCHEMA = T.StructType([
    T.StructField("gmtco_point", T.StringType()), T.StructField("FID", T.LongType()), T.StructField("frp", T.DoubleType()),
    T.StructField("site_point", T.StringType()), T.StructField("uuid", T.StringType()), T.StructField("det_id", T.LongType()),
])

#: Detections derived from ``events``: blobs for most types, scattered points for errors. Valid in Spark;
#: for DuckDB ``div`` is ``//``.
EVENTS_SQL = """SELECT event_id AS det_id,
  CASE WHEN event_type = 'error' THEN -104e0 + CAST((event_id * 7919) % 10007 AS DOUBLE) * 0.00031e0
       ELSE -104e0 + CAST(user_id % 15 AS DOUBLE) * 0.2e0 + CAST((event_id * 7919) % 101 AS DOUBLE) * 0.00031e0 END AS lon,
  CASE WHEN event_type = 'error' THEN 31e0 + CAST((event_id * 104729) % 10009 AS DOUBLE) * 0.0002e0
       ELSE 31e0 + CAST((user_id {div} 15) AS DOUBLE) * 0.2e0 + CAST((event_id * 104729) % 103 AS DOUBLE) * 0.00031e0 END AS lat,
  value AS frp, user_id AS fid, CAST(event_id AS {text}) AS uuid
FROM {events}"""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan a CSV of detections by its header; columns that the file lacks are null, others are ignored.

    ``det_id`` numbers the rows in file order unless the file has it. An empty
    file gives an empty table.
    """
    names = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in SCHEMA}
    held = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    rows = spark.read.option("header", True).schema(held).csv(path)
    have = [F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name != "det_id"]
    return rows.select(*have, (F.col("det_id") if "det_id" in names else F.monotonically_increasing_id()).alias("det_id"))


def locate(rows: DataFrame) -> DataFrame:
    """``rows`` with lon and lat from ``gmtco_point``, else from ``site_point``; null where neither parses."""
    spare = "site_point" in rows.columns
    parts = {n: F.coalesce(point_part("gmtco_point", k), point_part("site_point", k)) if spare else point_part("gmtco_point", k) for n, k in (("lon", 1), ("lat", 2))}
    return rows.withColumns(parts).withColumn("frp", F.col("frp").cast("double"))


def detections(source: DataFrame | str, spark: SparkSession) -> DataFrame:
    """Located detections of a table or of a CSV's path."""
    return locate(read_csv(spark, source) if isinstance(source, str) else source)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture: det_id, lon, lat, frp, fid, uuid."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(EVENTS_SQL.format(div="div", text="STRING", events="{events}"), events=events)

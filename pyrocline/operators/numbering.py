"""Numbers in the order of a key, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrocline.storage import settle


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``key, name``: the distinct values of ``key`` numbered from 0 in ascending order, null not counted.

    The values are dealt out by ranges; a number is the values of the ranges
    before, one sum for each range, and the place within the range.
    """
    values = rows.where(F.col(key).isNotNull()).select(key).distinct()
    dealt = settle(values.repartitionByRange(key).select(key, F.spark_partition_id().alias("__part")), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))
    parts = parts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return dealt.join(F.broadcast(parts), "__part").select(key, (F.col("__first") + place).cast("long").alias(name))

"""Heat map: every detection spread over a grid by a small Gaussian kernel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, HALF = 0.8, 2


def kernel() -> list[tuple[int, int, float]]:
    """(row step, column step, weight) of the 5 x 5 kernel, weights adding up to 1."""
    raw = [(y, x, math.exp(-(x * x + y * y) / (2 * SIGMA * SIGMA))) for y in range(-HALF, HALF + 1) for x in range(-HALF, HALF + 1)]
    total = sum(w for *_, w in raw)
    return [(y, x, w / total) for y, x, w in raw]


def extent(points: DataFrame) -> DataFrame:
    """``min_lon, max_lat, max_lon, min_lat``: one row."""
    return points.agg(F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"))


def heatmap(points: DataFrame, pixel: float = 0.006) -> DataFrame:
    """``row, col, weight``: cells with weight; row 0 is the northernmost, column 0 the westernmost.

    A point lies in cell floor((max lat - lat) / pixel), floor((lon - min lon) /
    pixel); weight that would fall outside the extent's rows and columns is cut
    off. Points are counted by cell before they are spread, so a cell with very
    many detections costs 25 rows. Points without a place are left out.
    """
    here = points.where("lon IS NOT NULL AND lat IS NOT NULL")
    box = extent(here).first()
    if box is None or box[0] is None:
        return here.sparkSession.createDataFrame([], "row long, col long, weight double")
    row, col = F.floor((F.lit(box.max_lat) - F.col("lat")) / pixel), F.floor((F.col("lon") - F.lit(box.min_lon)) / pixel)
    last_row, last_col = math.floor((box.max_lat - box.min_lat) / pixel), math.floor((box.max_lon - box.min_lon) / pixel)
    counted = here.groupBy(row.alias("r"), col.alias("c")).count()
    steps = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), F.lit(w).alias("w")) for y, x, w in kernel()])
    spread = counted.select("r", "c", "count", F.explode(steps).alias("k")).select((F.col("r") + F.col("k.dy")).alias("row"), (F.col("c") + F.col("k.dx")).alias("col"), (F.col("count") * F.col("k.w")).alias("w"))
    inside = spread.where(F.col("row").between(0, last_row) & F.col("col").between(0, last_col))
    return inside.groupBy("row", "col").agg(F.sum("w").alias("weight"))

"""Restriction to areas of interest: points strictly inside any ring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocline.functions.geometry import crosses, on_edge
from pyrocline.sources.outline import Ring, edges

#: Sides of all rings that may be sent to every executor; an outline is drawn by hand or by an agency, not by the data.
MAX_SIDES = 200_000


def with_in_bounds(points: DataFrame, rings: list[Ring]) -> DataFrame:
    """``points`` with ``in_bounds``.

    Even-odd ray casting; a point on a side or corner is outside; overlapping
    rings count once; without rings every point is inside; a point without a
    place is outside any ring. Each point meets its ring's sides as an array,
    so no join multiplies rows: rings are packed into one row for each cell of a
    coarse grid that their box touches.
    """
    if not rings:
        return points.withColumn("in_bounds", F.lit(True))
    if sum(map(len, rings)) > MAX_SIDES:
        raise ValueError(f"outlines have more than {MAX_SIDES} sides")
    sides = edges(points.sparkSession, rings)
    side = F.struct("x1", "y1", "x2", "y2")
    packed = sides.groupBy("poly_id", "lon0", "lat0", "lon1", "lat1").agg(F.collect_list(side).alias("sides"))
    cells = packed.withColumn("__cell_x", F.expr("explode(sequence(cast(floor(lon0) AS int), cast(floor(lon1) AS int)))")).withColumn(
        "__cell_y", F.expr("explode(sequence(cast(floor(lat0) AS int), cast(floor(lat1) AS int)))"))
    by_cell = cells.groupBy("__cell_x", "__cell_y").agg(F.collect_list(F.struct("sides")).alias("__rings"))
    keyed = points.withColumns({"__gx": F.floor("lon").cast("int"), "__gy": F.floor("lat").cast("int")})
    joined = keyed.join(F.broadcast(by_cell), (F.col("__gx") == F.col("__cell_x")) & (F.col("__gy") == F.col("__cell_y")), "left")

    def per_side(sql: str) -> str:
        for name in ("x1", "y1", "x2", "y2"):
            sql = sql.replace(name, f"s.{name}")
        return sql

    inside = (f"exists(__rings, r -> size(filter(r.sides, s -> {per_side(crosses('lon', 'lat'))})) % 2 = 1 "
              f"AND NOT exists(r.sides, s -> {per_side(on_edge('lon', 'lat'))}))")
    return joined.withColumn("in_bounds", F.coalesce(F.expr(inside), F.lit(False))).drop("__gx", "__gy", "__cell_x", "__cell_y", "__rings")

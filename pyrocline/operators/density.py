"""Density clustering (DBSCAN, Ester et al. 1996) and single linkage, on a grid.

Cells have a diagonal of just under ``eps``, so all points of a cell are
neighbours of one another. A cell with ``min_samples`` points is crowded: all of
its points are core points without any test. Only points of other cells, fewer
than ``min_samples`` in each, are compared with the points around them, so the
comparisons grow in proportion to the points, however dense a cell is.

Core points of a cell are one piece; pieces of nearby cells are linked if some
pair of their core points is within ``eps``. Eight extreme points of each cell
decide nearly all links between crowded cells; the other cell pairs compare
their core points. Components of pieces are the clusters. A border point joins
the neighbouring component with the smallest id, which is its smallest core id.

Joins here are merge joins by hint: Spark takes a stored table's compressed size
for its size, and would send millions of points to the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocline.operators.components import connected_components
from pyrocline.operators.numbering import numbered
from pyrocline.storage import settle

_REACH = 2
#: How much further than ``eps`` a cell's border may seem by rounding.
_SLACK = 1 + 1e-6


def _near(eps: float) -> str:
    return f"sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) <= {eps!r}D"


def _side(eps: float) -> float:
    return eps / 2**0.5 * (1 - 1e-9)


def _merged(table: DataFrame) -> DataFrame:
    return table.hint("merge")


def _gridded(points: DataFrame, eps: float) -> DataFrame:
    side = _side(eps)
    return points.where("lon IS NOT NULL AND lat IS NOT NULL").select(
        "det_id", "lon", "lat", F.floor(F.col("lon") / side).alias("cx"), F.floor(F.col("lat") / side).alias("cy"))


def _around(cells: DataFrame, forward: bool = False) -> DataFrame:
    """``cells`` (cx, cy, ...) with nx, ny: each cell within reach, the own one included; ``forward``: each pair of cells once."""
    offsets = [(x, y) for x in range(-_REACH, _REACH + 1) for y in range(-_REACH, _REACH + 1) if not forward or (x, y) > (0, 0)]
    listed = F.array(*[F.struct((F.col("cx") + x).alias("nx"), (F.col("cy") + y).alias("ny")) for x, y in offsets])
    return cells.withColumn("n", F.explode(listed)).select(*[c for c in cells.columns], "n.nx", "n.ny")


def _cut(eps: float) -> Column:
    """Whether the circle of ``eps`` around lon, lat reaches the cell nx, ny."""
    gaps = [F.greatest(F.col(n) * _side(eps) - F.col(at), F.col(at) - (F.col(n) + 1) * _side(eps), F.lit(0.0)) for n, at in (("nx", "lon"), ("ny", "lat"))]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] <= (eps * _SLACK) ** 2


def neighbour_counts(points: DataFrame, eps: float) -> DataFrame:
    """``det_id, neighbours``: points within ``eps`` of each point, itself included.

    All points of a cell are near one another and are counted, not compared.
    """
    grid = settle(_gridded(points, eps), "grid")
    cells = grid.groupBy("cx", "cy").agg(F.count("*").alias("own"))
    other = _around(grid).where("nx <> cx OR ny <> cy").where(_cut(eps)).alias("a").join(_merged(grid.alias("b")), F.expr(f"a.nx = b.cx AND a.ny = b.cy AND {_near(eps)}"))
    counted = other.groupBy("a.det_id").agg(F.count("*").alias("others"))
    return grid.join(_merged(cells), ["cx", "cy"]).join(_merged(counted), "det_id", "left").select("det_id", (F.col("own") + F.coalesce("others", F.lit(0))).alias("neighbours"))


def core_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``det_id, lon, lat, cx, cy, core`` of every point with a place, as a stored table."""
    grid = settle(_gridded(points, eps), "grid")
    cells = grid.groupBy("cx", "cy").count()
    crowded = cells.where(F.col("count") >= min_samples).select("cx", "cy")
    thin = grid.join(_merged(crowded), ["cx", "cy"], "left_anti")
    pairs = _around(thin).where(_cut(eps)).alias("a").join(_merged(grid.alias("b")), F.expr(f"a.nx = b.cx AND a.ny = b.cy AND {_near(eps)}"))
    tested = pairs.groupBy("a.det_id").count().where(F.col("count") >= min_samples).select("det_id", F.lit(True).alias("ok"))
    dense = grid.join(_merged(crowded), ["cx", "cy"], "left_semi").withColumn("core", F.lit(True))
    rest = thin.join(_merged(tested), "det_id", "left").withColumn("core", F.coalesce("ok", F.lit(False)))
    columns = ["det_id", "lon", "lat", "cx", "cy", "core"]
    return settle(dense.select(columns).unionByName(rest.select(columns)), "core")


def _piece_links(core: DataFrame, eps: float) -> DataFrame:
    """``a, b``: smallest core ids of nearby cells that have core points within ``eps`` of each other."""
    keys = {"w": F.col("lon"), "s": F.col("lat"), "d": F.col("lon") + F.col("lat"), "e": F.col("lon") - F.col("lat")}
    place = F.struct("lon", "lat")
    ends = [f(place, by).alias(f"{n}{k}") for n, by in keys.items() for k, f in enumerate((F.min_by, F.max_by))]
    cells = settle(core.groupBy("cx", "cy").agg(F.min("det_id").alias("piece"), *ends).select(
        "cx", "cy", "piece", F.array_distinct(F.array(*[f"{n}{k}" for n in keys for k in (0, 1)])).alias("ends")), "pieces")
    met = _around(cells, forward=True).alias("a").join(_merged(cells.alias("b")), F.expr("a.nx = b.cx AND a.ny = b.cy"))
    quick = f"exists(a.ends, p -> exists(b.ends, q -> sqrt((p.lon - q.lon) * (p.lon - q.lon) + (p.lat - q.lat) * (p.lat - q.lat)) <= {eps!r}D))"
    met = settle(met.select(F.col("a.piece").alias("a"), F.col("b.piece").alias("b"), F.col("a.cx").alias("ax"), F.col("a.cy").alias("ay"),
                            F.col("b.cx").alias("bx"), F.col("b.cy").alias("by"), F.expr(quick).alias("linked")), "met")
    open_pairs = met.where("NOT linked").select("a", "b", "ax", "ay", "bx", "by")
    own = core.select("cx", "cy", "lon", "lat")
    left = open_pairs.alias("m").join(_merged(own.alias("p")), F.expr("m.ax = p.cx AND m.ay = p.cy")).select("m.a", "m.b", "m.bx", "m.by", "p.lon", "p.lat")
    slow = left.alias("a").join(_merged(own.alias("b")), F.expr(f"a.bx = b.cx AND a.by = b.cy AND {_near(eps)}")).select(F.col("a.a").alias("a"), F.col("a.b").alias("b")).distinct()
    return met.where("linked").select("a", "b").unionByName(slow)


def cluster(points: DataFrame, eps: float = 0.006, min_samples: int = 4) -> DataFrame:
    """``det_id, label``: cluster number of each point, -1 for noise.

    ``points`` has det_id (unique), lon, lat. Distances are Euclidean in
    degrees, ``eps`` included; a point is its own neighbour. Clusters are
    numbered by their smallest core id. Points without a place are noise.
    ``min_samples`` 1 is single linkage at distance ``eps``. An empty table
    gives an empty result. Other columns are not read.
    """
    found = core_points(points, eps, min_samples)
    core = found.where("core")
    pieces = core.groupBy("cx", "cy").agg(F.min("det_id").alias("piece"))
    parts = connected_components(_piece_links(core, eps)).withColumnRenamed("node", "piece")
    pieces = settle(pieces.join(_merged(parts), "piece", "left").select("cx", "cy", F.coalesce("component", "piece").alias("component")), "components")
    inner = core.join(_merged(pieces), ["cx", "cy"]).select("det_id", "component")
    edge = found.where("NOT core")
    held = core.join(_merged(pieces), ["cx", "cy"])
    border = _around(edge).where(_cut(eps)).alias("a").join(_merged(held.alias("b")), F.expr(f"a.nx = b.cx AND a.ny = b.cy AND {_near(eps)}")).groupBy("a.det_id").agg(F.min("b.component").alias("component"))
    members = inner.unionByName(border)
    numbers = numbered(pieces, "component", "label")
    labels = members.join(_merged(numbers), "component").select("det_id", "label")
    return points.select("det_id").join(_merged(labels), "det_id", "left").select("det_id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))

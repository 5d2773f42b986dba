"""Outlines: areas of interest from GeoJSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

Ring = list[tuple[float, float]]


def rings_of(geometry: dict) -> list[Ring]:
    """Exterior rings of a Polygon or MultiPolygon; holes are refused."""
    kind, coordinates = geometry.get("type"), geometry["coordinates"]
    polygons = coordinates if kind == "MultiPolygon" else [coordinates]
    if kind not in ("Polygon", "MultiPolygon") or any(len(p) != 1 for p in polygons):
        raise ValueError("outlines are polygons without holes")
    return [[(float(x), float(y)) for x, y, *_ in p[0]] for p in polygons]


def read_outline(spark: SparkSession, outline: dict | str | None) -> list[Ring]:
    """Rings of a feature (dict), of a GeoJSON file in any storage that Spark reads, or none."""
    if not outline:
        return []
    if isinstance(outline, dict):
        found = outline
    else:
        found = json.loads("\n".join(r.value for r in spark.read.text(outline, wholetext=True).collect()))
    features = found["features"] if found.get("type") == "FeatureCollection" else [found]
    return [ring for feature in features for ring in rings_of(feature.get("geometry", feature))]


def edges(spark: SparkSession, rings: list[Ring]) -> DataFrame:
    """``poly_id, x1, y1, x2, y2`` and the ring's box: one row for each side of each ring."""
    rows = []
    for n, ring in enumerate(rings):
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        xs, ys = [p[0] for p in closed], [p[1] for p in closed]
        rows += [(n, *a, *b, min(xs), min(ys), max(xs), max(ys)) for a, b in zip(closed, closed[1:], strict=False)]
    return spark.createDataFrame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double, lon0 double, lat0 double, lon1 double, lat1 double")


def midpoints(rings: list[Ring]) -> list[tuple[int, float, float]]:
    """(ring, longitude, latitude) of the middle of each ring's box."""
    return [(n, (min(x for x, _ in r) + max(x for x, _ in r)) / 2, (min(y for _, y in r) + max(y for _, y in r)) / 2) for n, r in enumerate(rings)]


def corners(spark: SparkSession, rings: list[Ring]) -> DataFrame:
    """``poly_id, corner, lon, lat``: the coordinates of all rings."""
    rows = [(n, k, x, y) for n, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "poly_id int, corner int, lon double, lat double")

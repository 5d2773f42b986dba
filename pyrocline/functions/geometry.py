"""Points, rings and boxes as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
POINT = rf"^\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$"


def point_part(wkt: str, group: int) -> Column:
    """Longitude (1) or latitude (2) of WKT text ``POINT (lon lat)``; null for anything else."""
    return F.regexp_extract(F.upper(F.col(wkt)), POINT, group).try_cast("double")


def ring_of_box(min_lon: str, min_lat: str, max_lon: str, max_lat: str) -> Column:
    """Closed ring of a box, clockwise from the south-west: SW, NW, NE, SE, SW."""
    corners = ((min_lon, min_lat), (min_lon, max_lat), (max_lon, max_lat), (max_lon, min_lat), (min_lon, min_lat))
    return F.array(*[F.array(F.col(x).cast("double"), F.col(y).cast("double")) for x, y in corners])


def crosses(lon: str, lat: str) -> str:
    """SQL: a ray to the east of the point crosses edge (x1, y1, x2, y2)."""
    return (f"((y1 > {lat}) <> (y2 > {lat})) AND {lon} < (x2 - x1) * ({lat} - y1) / (CASE WHEN y2 = y1 THEN 1e0 ELSE y2 - y1 END) + x1")


def on_edge(lon: str, lat: str) -> str:
    """SQL: the point lies on edge (x1, y1, x2, y2), its ends included."""
    return (f"(x2 - x1) * ({lat} - y1) = (y2 - y1) * ({lon} - x1) AND {lon} BETWEEN least(x1, x2) AND greatest(x1, x2) "
            f"AND {lat} BETWEEN least(y1, y2) AND greatest(y1, y2)")

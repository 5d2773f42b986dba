"""Transverse Mercator in UTM zones, by the series of Snyder (1987), as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

# WGS-84, UTM scale and false easting.
_A, _F, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)


def with_utm(points: DataFrame, zone: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with easting and northing in metres; northings south of the equator are below 0."""
    middle = -183 + 6 * zone
    arc = [1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256, 3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024, 15 * _E2**2 / 256 + 45 * _E2**3 / 1024, 35 * _E2**3 / 3072]
    columns = points.columns
    out = points.selectExpr("*", f"radians({lat}) AS u_p", f"radians({lon} - {middle}) AS u_l")
    out = out.selectExpr("*", "tan(u_p) * tan(u_p) AS u_t", f"{_EP2!r}D * cos(u_p) * cos(u_p) AS u_c", "u_l * cos(u_p) AS u_a", f"{_A!r}D / sqrt(1 - {_E2!r}D * sin(u_p) * sin(u_p)) AS u_n",
                         f"{_A!r}D * ({arc[0]!r}D * u_p - {arc[1]!r}D * sin(2 * u_p) + {arc[2]!r}D * sin(4 * u_p) - {arc[3]!r}D * sin(6 * u_p)) AS u_m")
    east = f"{_EAST!r}D + {_K0!r}D * u_n * (u_a + (1 - u_t + u_c) * pow(u_a, 3) / 6 + (5 - 18 * u_t + u_t * u_t + 72 * u_c - {58 * _EP2!r}D) * pow(u_a, 5) / 120)"
    north = (f"{_K0!r}D * (u_m + u_n * tan(u_p) * (u_a * u_a / 2 + (5 - u_t + 9 * u_c + 4 * u_c * u_c) * pow(u_a, 4) / 24"
             f" + (61 - 58 * u_t + u_t * u_t + 600 * u_c - {330 * _EP2!r}D) * pow(u_a, 6) / 720))")
    return out.selectExpr(*[f"`{c}`" for c in columns], f"{east} AS easting", f"{north} AS northing")

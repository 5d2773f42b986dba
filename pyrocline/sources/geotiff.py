"""A small GeoTIFF writer: one band of 32-bit floats, EPSG 4326."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from pyrocline.sources.sinks import write_bytes

#: Larger rasters stay tables of cells (100 MB as a file).
MAX_CELLS = 25_000_000


def encode(raster: np.ndarray, west: float, north: float, pixel: float) -> bytes:
    """``raster`` (rows from north to south) as a little-endian TIFF with its place on earth."""
    rows, cols = raster.shape
    body = raster.astype("<f4").tobytes()
    doubles = {33550: (pixel, pixel, 0.0), 33922: (0.0, 0.0, 0.0, west, north, 0.0)}
    keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    # Tag, type (3 short, 4 long, 12 double), values.
    tags = [(256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (32,)), (259, 3, (1,)), (262, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, (len(body),)),
            (339, 3, (3,)), *((t, 12, v) for t, v in doubles.items()), (34735, 3, keys)]
    at = 8 + len(body) + len(body) % 2
    extra_at, entries, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        packed = struct.pack(f"<{len(values)}{'HId'[(3, 4, 12).index(kind)]}", *values)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += packed
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def write_geotiff(cells: DataFrame, box: DataFrame, pixel: float, path: str) -> bool:
    """Write heat map ``cells`` (row, col, weight) as a GeoTIFF; False, and no file, if the raster is empty or above MAX_CELLS."""
    corner = box.first()
    if corner is None or corner.min_lon is None:
        return False
    rows, cols = (int(np.floor((b - a) / pixel)) + 1 for a, b in ((corner.min_lat, corner.max_lat), (corner.min_lon, corner.max_lon)))
    if rows * cols > MAX_CELLS:
        return False
    raster = np.zeros((rows, cols), np.float32)
    for row in cells.toLocalIterator():
        raster[row.row, row.col] = row.weight

    def parts() -> Iterator[bytes]:
        whole = encode(raster, corner.min_lon, corner.max_lat, pixel)
        for at in range(0, len(whole), 1 << 20):
            yield whole[at:at + (1 << 20)]

    write_bytes(cells.sparkSession, path, parts())
    return True

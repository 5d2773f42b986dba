"""Sinks: GeoJSON features, heat map tables, centroid and annotated CSV."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Properties of a cluster's feature, in their order (fixed).
PROPERTIES = ("name", "num_collects", "num_in_cluster", "signal_type", "cluster_id", "lon_lat_centroid", "distance_mean", "distance_stddev", "distance_max",
              "distance_min", "intensity_mean", "intensity_stddev", "intensity_max", "intensity_min", "model_prediction", "order")


def output_paths(folder: str, source: str) -> dict[str, str]:
    """Where a run's files go: named after the source without its folder and extension."""
    base = source.rstrip("/").rsplit("/", 1)[-1]
    base = base[:base.rindex(".")] if "." in base[1:] else base
    root = f"{folder.rstrip('/')}/{base}"
    return {"base": base, "points": f"{root}_clusters_v2_pt.json", "polygons": f"{root}_clusters_v2_poly.json", "heatmap": f"{root}_heatmap",
            "hierarchical": f"{root}_hierarchical_poly.json", "annotated": f"{root}_mod2.csv", "centroids": f"{root}_centroids.csv"}


def _feature(clusters: DataFrame, kind: str, coordinates: Column) -> DataFrame:
    names = [n for n in PROPERTIES if n in clusters.columns]
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*names).alias("properties"))
    return clusters.select("cluster_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def point_features(clusters: DataFrame) -> DataFrame:
    """``cluster_id, feature``: a GeoJSON point at each centroid."""
    return _feature(clusters, "Point", F.col("lon_lat_centroid"))


def polygon_features(clusters: DataFrame) -> DataFrame:
    """``cluster_id, feature``: a GeoJSON polygon around each cluster."""
    return _feature(clusters, "Polygon", F.array("polygon"))


def write_bytes(spark: SparkSession, path: str, parts: Iterator[bytes]) -> None:
    """One file in any storage that Spark reaches, written piece by piece."""
    jvm = spark._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)  # noqa: SLF001
    try:
        for part in parts:
            stream.write(bytearray(part))
    finally:
        stream.close()


def write_collection(features: DataFrame, path: str) -> None:
    """One FeatureCollection file, in the order of ``cluster_id``; rows pass the driver one partition at a time. Without rows it has no features."""
    def parts() -> Iterator[bytes]:
        yield b'{"type": "FeatureCollection", "features": ['
        for n, row in enumerate(features.orderBy("cluster_id").toLocalIterator()):
            yield ((",\n" if n else "\n") + row.feature).encode()
        yield b"]}\n"

    write_bytes(features.sparkSession, path, parts())


def write_heatmap(cells: DataFrame, box: DataFrame, pixel: float, path: str) -> None:
    """Cells as a Parquet table, and beside it one row of metadata: geotransform and coordinate system."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    corner = [F.col("min_lon"), F.lit(pixel), F.lit(0.0), F.col("max_lat"), F.lit(0.0), F.lit(-pixel)]
    box.select(F.array(*[c.cast("double") for c in corner]).alias("geotransform"), F.lit(4326).alias("epsg"), F.lit(1).alias("bands")).write.mode("overwrite").parquet(f"{path}/metadata")


def write_centroids(clusters: DataFrame, path: str) -> None:
    """CSV of latitude, longitude; values quoted with | where needed."""
    clusters.select(F.col("centroid_lat").alias("latitude"), F.col("centroid_lon").alias("longitude")).write.mode("overwrite").option("quote", "|").csv(path, header=True)


def write_annotated(rows: DataFrame, path: str) -> None:
    """CSV of the input rows with their ``cluster_id``."""
    rows.write.mode("overwrite").csv(path, header=True)

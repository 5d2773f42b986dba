"""Cluster tables: membership, centroids, spread, intensity, boxes and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocline.functions.geodesic import with_distance
from pyrocline.functions.geometry import ring_of_box
from pyrocline.operators.numbering import numbered

#: Order of the classifier's inputs (fixed).
FEATURES = ("distance_mean", "distance_stddev", "intensity_mean", "intensity_stddev", "distance_max", "distance_min", "intensity_max", "intensity_min")


def exact_mean(column: str) -> Column:
    """Mean by an exact decimal sum, the same in any order of rows; for values of up to 8 decimals, others are rounded to that."""
    return F.sum(F.col(column).cast("decimal(18,8)")).cast("double") / F.count(F.col(column))


def membership(labels: DataFrame, min_members: int = 5) -> DataFrame:
    """``det_id, cluster_id``: points of clusters with at least ``min_members``, clusters renumbered from 0 in label order."""
    kept = labels.where("label >= 0").groupBy("label").count().where(F.col("count") >= min_members)
    numbers = numbered(kept, "label", "cluster_id")
    return labels.join(numbers, "label").select("det_id", "cluster_id")


def centroids(members: DataFrame) -> DataFrame:
    """``cluster_id, centroid_lon, centroid_lat, num_in_cluster`` of ``members`` (cluster_id, lon, lat)."""
    return members.groupBy("cluster_id").agg(exact_mean("lon").alias("centroid_lon"), exact_mean("lat").alias("centroid_lat"), F.count("*").alias("num_in_cluster"))


def distances(members: DataFrame, centres: DataFrame) -> DataFrame:
    """``members`` with the centroid and ``distance``: metres from it along the geodesic."""
    joined = members.join(centres.select("cluster_id", "centroid_lon", "centroid_lat"), "cluster_id")
    return with_distance(joined, "centroid_lat", "centroid_lon", "lat", "lon", "distance")


def spatial_stats(measured: DataFrame) -> DataFrame:
    """Distance mean, population deviation, max and min by cluster; 0 where there is nothing to measure."""
    some = {"mean": F.avg, "stddev": F.stddev_pop, "max": F.max, "min": F.min}
    return measured.groupBy("cluster_id").agg(*[F.coalesce(f("distance"), F.lit(0.0)).alias(f"distance_{n}") for n, f in some.items()])


def intensity_stats(members: DataFrame) -> DataFrame:
    """frp mean, population deviation, max, min and the number of members by cluster."""
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("num_in_cluster"), exact_mean("frp").alias("intensity_mean"), F.coalesce(F.stddev_pop("frp"), F.lit(0.0)).alias("intensity_stddev"),
        F.max("frp").alias("intensity_max"), F.min("frp").alias("intensity_min"))


def boxes(members: DataFrame) -> DataFrame:
    """``cluster_id, min_lon, min_lat, max_lon, max_lat``."""
    return members.groupBy("cluster_id").agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def features(members: DataFrame) -> DataFrame:
    """One row for each cluster: centroid, size, distance and intensity statistics, box and polygon.

    ``members`` has cluster_id, det_id, lon, lat, frp and may have uuid: then
    ``order`` is the one of the smallest det_id.
    """
    centres = centroids(members)
    measured = distances(members, centres)
    out = centres.join(spatial_stats(measured), "cluster_id").join(intensity_stats(members).drop("num_in_cluster"), "cluster_id").join(boxes(members), "cluster_id")
    out = out.withColumn("polygon", ring_of_box("min_lon", "min_lat", "max_lon", "max_lat"))
    return out.join(order_of(members), "cluster_id") if "uuid" in members.columns else out


def order_of(members: DataFrame) -> DataFrame:
    """``cluster_id, order``: the uuid of each cluster's first row."""
    return members.groupBy("cluster_id").agg(F.min_by("uuid", "det_id").alias("order"))


def distinct_collects(rows: DataFrame, valid_share: float, column: str = "fid") -> DataFrame:
    """``num_collects, num_valid``: distinct collects of all rows, a null counting as one, and the validity threshold."""
    n = F.count_distinct(column) + F.max(F.col(column).isNull().cast("long"))
    counted = rows.agg(F.coalesce(n, F.lit(0)).cast("long").alias("num_collects"))
    return counted.withColumn("num_valid", F.floor(F.col("num_collects") * F.lit(valid_share)).cast("long"))


def name_of(base: str, number: str = "cluster_id") -> Column:
    """First word of the base name, then the number with at least four digits."""
    return F.format_string("%s_%04d", F.lit(base.split(" ")[0]), F.col(number))


def properties(clusters: DataFrame, collects: DataFrame, base: str, signal_type: str) -> DataFrame:
    """``clusters`` with name, signal_type, num_collects and lon_lat_centroid."""
    one = collects.select("num_collects").first()[0]
    return clusters.withColumns({"name": name_of(base), "signal_type": F.lit(signal_type), "num_collects": F.lit(one).cast("long"),
                                 "lon_lat_centroid": F.array("centroid_lon", "centroid_lat")})


def annotate(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with their ``cluster_id``, null for those in no cluster."""
    return rows.join(members.select("det_id", "cluster_id"), "det_id", "left")

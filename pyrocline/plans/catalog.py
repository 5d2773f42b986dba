"""Registered queries over the detections fixture, and the same in DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocline.config import Settings
from pyrocline.functions import utm
from pyrocline.functions.geodesic import distance_sql
from pyrocline.functions.geometry import POINT, crosses, on_edge
from pyrocline.operators import clusters, density, mixture, raster, scoring
from pyrocline.plans.engine import Run
from pyrocline.sources import detections, outline, sinks
from pyrocline.storage import fresh_path

FLAGSHIP = "cluster_predictions"
RING = [(-103.9, 31.05), (-102.5, 31.1), (-101.9, 32.6), (-103.2, 33.0), (-103.9, 31.05)]
#: Stand-in weights: the classifier's own were never published.
MODEL = scoring.Linear((-0.004, 0.002, 0.031, -0.017, 0.001, -0.003, 0.005, 0.011), -2.75)
Query = Callable[[SparkSession, str], DataFrame]


def _run(spark: SparkSession, sf_dir: str, rings: list | None = None) -> Run:
    return Run(detections.from_events(spark, sf_dir), rings or [])


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).members()


def detections_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places parsed from WKT text."""
    rows = detections.from_events(spark, sf_dir)
    text = rows.select("det_id", "frp", F.format_string("POINT (%.5f %.5f)", "lon", "lat").alias("gmtco_point"))
    return detections.locate(text).select("det_id", "gmtco_point", "lon", "lat", "frp")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as a CSV and scanned again."""
    rows = detections.from_events(spark, sf_dir)
    path = fresh_path(spark, "csv")
    rows.select("det_id", F.format_string("POINT (%.5f %.5f)", "lon", "lat").alias("gmtco_point"), F.col("fid").alias("FID"), "frp", "uuid").write.csv(path, header=True)
    return detections.detections(path, spark).select("det_id", "gmtco_point", F.col("FID").alias("fid"), "frp", "uuid", "lon", "lat")


def site_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from ``site_point`` where ``gmtco_point`` is null or no point."""
    rows = detections.from_events(spark, sf_dir)
    text = F.format_string("POINT (%.5f %.5f)", "lon", "lat")
    known = F.when(F.col("det_id") % 7 > 1, text).when(F.col("det_id") % 7 == 1, "POINT EMPTY")
    spare = F.when(F.col("det_id") % 3 > 0, F.format_string("POINT (%.5f %.5f)", F.col("lat"), F.col("lon")))
    return detections.locate(rows.select("det_id", "frp", known.alias("gmtco_point"), spare.alias("site_point"))).select("det_id", "lon", "lat")


def outline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary points of the outline, written as GeoJSON and read again."""
    path = fresh_path(spark, "outline")
    feature = {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[RING], [[[x + 10, y] for x, y in RING]]]}}
    sinks.write_bytes(spark, path, iter([json.dumps({"type": "FeatureCollection", "features": [feature]}).encode()]))
    return outline.corners(spark, outline.read_outline(spark, path))


def utm_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eastings and northings in zone 13, to the centimetre."""
    found = utm.with_utm(detections.from_events(spark, sf_dir).select("det_id", "lon", "lat"), 13)
    return found.select("det_id", F.round("easting", 2).alias("easting"), F.round("northing", 2).alias("northing"))


def annotated_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections with their cluster, written as a CSV and read again."""
    run, path = _run(spark, sf_dir, [RING]), fresh_path(spark, "annotated")
    sinks.write_annotated(clusters.annotate(run.rows, run.members()).select("det_id", "frp", "cluster_id"), path)
    return spark.read.schema("det_id long, frp double, cluster_id long").csv(path, header=True)


def centroid_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of kept clusters, written as a CSV and read again."""
    path = fresh_path(spark, "centroids")
    sinks.write_centroids(clusters.centroids(_members(spark, sf_dir)), path)
    return spark.read.schema("latitude double, longitude double").csv(path, header=True)


def valid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters that reach a validity threshold of a tenth of the collects."""
    run = Run(detections.from_events(spark, sf_dir), [], Settings(valid_share=0.1, apply_valid_share=True))
    return run.members().select("det_id", "cluster_id")


def distinct_collects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct collects and the validity threshold."""
    return _run(spark, sf_dir).collects()


def in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections inside the outline."""
    return _run(spark, sf_dir, [RING]).inside().select("det_id", "lon", "lat")


def out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections outside the outline."""
    return _run(spark, sf_dir, [RING]).outside().select("det_id", "lon", "lat")


def heatmap_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat map's kernel."""
    return spark.createDataFrame(raster.kernel(), "dy long, dx long, weight double").withColumn("weight", F.round("weight", 12))


def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat map of all detections."""
    return _run(spark, sf_dir).heatmap().select("row", "col", F.round("weight", 9).alias("weight"))


def eps_neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each detection within eps."""
    return density.neighbour_counts(detections.from_events(spark, sf_dir), 0.006)


def core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core points."""
    return density.core_points(detections.from_events(spark, sf_dir), 0.006, 4).where("core").select("det_id")


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density labels."""
    return _run(spark, sf_dir).labels()


def dbscan_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in no cluster."""
    return _run(spark, sf_dir).labels().where("label = -1").select("det_id")


def cluster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of kept clusters."""
    return _members(spark, sf_dir).select("det_id", "cluster_id")


def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids and sizes of kept clusters."""
    return clusters.centroids(_members(spark, sf_dir))


def cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres from each member to its centroid."""
    own = _members(spark, sf_dir)
    return clusters.distances(own, clusters.centroids(own)).select("det_id", "cluster_id", F.round("distance", 3).alias("distance"))


def cluster_spatial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of kept clusters."""
    own = _members(spark, sf_dir)
    stats = clusters.spatial_stats(clusters.distances(own, clusters.centroids(own)))
    return stats.select("cluster_id", *[F.round(f"distance_{n}", 3).alias(f"distance_{n}") for n in ("mean", "stddev", "max", "min")])


def cluster_intensity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity of kept clusters."""
    return clusters.intensity_stats(_members(spark, sf_dir)).withColumn("intensity_stddev", F.round("intensity_stddev", 6))


def cluster_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of kept clusters."""
    return clusters.boxes(_members(spark, sf_dir))


def cluster_polygon_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the boxes' rings, one row each."""
    ring = clusters.boxes(_members(spark, sf_dir)).select("cluster_id", F.posexplode(clusters.ring_of_box("min_lon", "min_lat", "max_lon", "max_lat")).alias("corner", "p"))
    return ring.select("cluster_id", F.col("corner").cast("long").alias("corner"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def _shown(table: DataFrame) -> list:
    digits = {"distance_mean": 3, "distance_stddev": 3, "distance_max": 3, "distance_min": 3, "intensity_stddev": 6}
    return [F.round(n, digits[n]).alias(n) if n in digits else F.col(n) for n in clusters.FEATURES]


def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier inputs of kept clusters."""
    table = clusters.features(_members(spark, sf_dir))
    return table.select("cluster_id", "num_in_cluster", *_shown(table))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    return run.classified(run.members(), MODEL, "fires of june")


def cluster_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified clusters."""
    table = _table(spark, sf_dir)
    return table.select("cluster_id", "name", "num_collects", "num_in_cluster", "signal_type", "centroid_lon", "centroid_lat", *_shown(table), "model_prediction")


def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features, read back from their text."""
    schema = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<name:string,cluster_id:bigint,num_in_cluster:bigint,model_prediction:string>"
    made = sinks.point_features(_table(spark, sf_dir)).select(F.from_json("feature", schema).alias("f"))
    return made.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def geojson_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon features, read back from their text: south-west and north-east corners."""
    schema = "geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<name:string,cluster_id:bigint>"
    made = sinks.polygon_features(_table(spark, sf_dir)).select(F.from_json("feature", schema).alias("f")).withColumn("ring", F.col("f.geometry.coordinates")[0])
    return made.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.size("ring").cast("long").alias("corners"), F.col("ring")[0][0].alias("min_lon"),
                       F.col("ring")[0][1].alias("min_lat"), F.col("ring")[2][0].alias("max_lon"), F.col("ring")[2][1].alias("max_lat"))


def hierarchical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of single-linkage clusters."""
    return _run(spark, sf_dir).hierarchical().select("det_id", "cluster_id")


def annotated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections with their cluster, restricted to the outline."""
    run = _run(spark, sf_dir, [RING])
    return clusters.annotate(run.rows, run.members()).select("det_id", "frp", "cluster_id")


def order_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First uuid of kept clusters."""
    return clusters.order_of(_members(spark, sf_dir))


def outline_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle of the outline's box."""
    return spark.createDataFrame(outline.midpoints([RING]), "poly_id long, lon double, lat double")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[mixture.Mixture, DataFrame]:
    return _run(spark, sf_dir).mixture()


def gmm_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest mixture component of each detection."""
    return mixture.assign(*_mixture(spark, sf_dir))


def gmm_semisoft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture components with a posterior above 0.4."""
    return mixture.assign_soft(*_mixture(spark, sf_dir))


def gmm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the mixture's components."""
    return spark.createDataFrame(mixture.means(_mixture(spark, sf_dir)[0]), "label long, lon double, lat double")


def classifier_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a classifier trained to tell large clusters."""
    table = clusters.features(_members(spark, sf_dir)).withColumn("target", (F.col("num_in_cluster") > 30).cast("double"))
    model = scoring.train(table, "target")
    return spark.createDataFrame([*zip(clusters.FEATURES, model.weights, strict=True), ("intercept", model.intercept)], "input string, weight double")


_QUERIES = (detections_scan, csv_scan, site_point, outline_file, utm_coordinates, annotated_csv, centroid_csv, valid_clusters, distinct_collects, in_bounds, out_of_bounds, heatmap_kernel, heatmap_cells, eps_neighbor_counts, core_points, dbscan_labels, dbscan_noise,
            cluster_membership, cluster_centroids, cluster_distances, cluster_spatial_stats, cluster_intensity_stats, cluster_bbox, cluster_polygon_ring, cluster_features,
            cluster_predictions, geojson_points, geojson_polygons, hierarchical_clusters, annotated_rows, order_property, outline_midpoint, gmm_hard, gmm_semisoft,
            gmm_centroids, classifier_train)


def queries() -> dict[str, Query]:
    """Name and function of each query."""
    return {f.__name__: f for f in _QUERIES}


# The same in DuckDB SQL, written down from the definitions and not from the operators.

_EXACT = "CAST(sum(CAST({0} AS DECIMAL(18,8))) AS DOUBLE) / count(*)"


def _labels_sql(eps: str = "0.006e0", least: int = 4, where: str = "true") -> str:
    return f"""WITH RECURSIVE det AS MATERIALIZED ({detections.EVENTS_SQL.format(div="//", text="VARCHAR", events="events")}),
pts AS MATERIALIZED (SELECT *, CAST(floor(lon / {eps}) AS BIGINT) AS cx, CAST(floor(lat / {eps}) AS BIGINT) AS cy FROM det WHERE {where}),
pairs AS MATERIALIZED (SELECT a.det_id AS a, b.det_id AS b FROM (SELECT p.*, x.dx, y.dy FROM pts p, (VALUES (-1), (0), (1)) x(dx), (VALUES (-1), (0), (1)) y(dy)) a
  JOIN pts b ON b.cx = a.cx + a.dx AND b.cy = a.cy + a.dy WHERE sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) <= {eps}),
core AS MATERIALIZED (SELECT a AS det_id FROM pairs GROUP BY a HAVING count(*) >= {least}),
sides AS MATERIALIZED (SELECT p.a, p.b FROM pairs p JOIN core x ON x.det_id = p.a JOIN core y ON y.det_id = p.b),
reach AS (SELECT det_id AS node, det_id AS root FROM core UNION SELECT s.b, r.root FROM reach r JOIN sides s ON s.a = r.node AND s.b > r.root),
comp AS MATERIALIZED (SELECT node, min(root) AS component FROM reach GROUP BY node),
near AS MATERIALIZED (SELECT p.a AS det_id, min(c.component) AS component FROM pairs p JOIN comp c ON c.node = p.b GROUP BY p.a),
num AS MATERIALIZED (SELECT component, row_number() OVER (ORDER BY component) - 1 AS label FROM (SELECT DISTINCT component FROM comp)),
labels AS MATERIALIZED (SELECT p.det_id, coalesce(n.label, -1) AS label FROM pts p LEFT JOIN near e ON e.det_id = p.det_id LEFT JOIN num n ON n.component = e.component)"""


def _members_sql(keep: int = 5, **other: object) -> str:
    return _labels_sql(**other) + f""",
kept AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster_id FROM (SELECT label FROM labels WHERE label >= 0 GROUP BY label HAVING count(*) >= {keep})),
m AS MATERIALIZED (SELECT d.*, k.cluster_id FROM det d JOIN labels l ON l.det_id = d.det_id JOIN kept k ON k.label = l.label)"""


def _features_sql() -> str:
    geodesic = distance_sql("j", "centroid_lat", "centroid_lon", "lat", "lon", "distance")
    return _members_sql() + f""",
c AS MATERIALIZED (SELECT cluster_id, {_EXACT.format('lon')} AS centroid_lon, {_EXACT.format('lat')} AS centroid_lat, count(*) AS num_in_cluster FROM m GROUP BY cluster_id),
j AS MATERIALIZED (SELECT m.*, c.centroid_lon, c.centroid_lat FROM m JOIN c USING (cluster_id)),
{geodesic},
ds AS MATERIALIZED (SELECT cluster_id, avg(distance) AS distance_mean, stddev_pop(distance) AS distance_stddev, max(distance) AS distance_max, min(distance) AS distance_min FROM g GROUP BY cluster_id),
fs AS MATERIALIZED (SELECT cluster_id, {_EXACT.format('frp')} AS intensity_mean, stddev_pop(frp) AS intensity_stddev, max(frp) AS intensity_max, min(frp) AS intensity_min FROM m GROUP BY cluster_id),
bx AS MATERIALIZED (SELECT cluster_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM m GROUP BY cluster_id),
t AS MATERIALIZED (SELECT *, CASE WHEN {MODEL.margin_sql()} > 0 THEN 'manmade' ELSE 'wildfire' END AS model_prediction,
  printf('fires_%04d', cluster_id) AS name, (SELECT count(DISTINCT fid) FROM det) AS num_collects
  FROM c JOIN ds USING (cluster_id) JOIN fs USING (cluster_id) JOIN bx USING (cluster_id))"""


def _shown_sql() -> str:
    digits = {"distance_mean": 3, "distance_stddev": 3, "distance_max": 3, "distance_min": 3, "intensity_stddev": 6}
    return ", ".join(f"round({n}, {digits[n]}) AS {n}" if n in digits else n for n in clusters.FEATURES)


def _inside_sql() -> str:
    sides = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(RING, RING[1:], strict=False))
    return (f"(SELECT count(*) FROM (VALUES {sides}) e(x1, y1, x2, y2) WHERE {crosses('det.lon', 'det.lat')}) % 2 = 1 "
            f"AND NOT EXISTS (SELECT 1 FROM (VALUES {sides}) e(x1, y1, x2, y2) WHERE {on_edge('det.lon', 'det.lat')})")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of each query that SQL can express."""
    det = f"WITH det AS MATERIALIZED ({detections.EVENTS_SQL.format(div='//', text='VARCHAR', events='events')})"
    steps = ", ".join(f"({k})" for k in range(-raster.HALF, raster.HALF + 1))
    weight = f"exp(-(x.dx * x.dx + y.dy * y.dy) / {2 * raster.SIGMA * raster.SIGMA!r}e0)"
    kernel = f"k AS MATERIALIZED (SELECT dy, dx, w / sum(w) OVER () AS w FROM (SELECT y.dy, x.dx, {weight} AS w FROM (VALUES {steps}) x(dx), (VALUES {steps}) y(dy)))"
    point = POINT.replace("'", "''")
    ring = " UNION ALL ".join(f"SELECT cluster_id, {n}::BIGINT AS corner, {x} AS lon, {y} AS lat FROM bx" for n, (x, y) in enumerate(
        [("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "max_lat"), ("max_lon", "min_lat"), ("min_lon", "min_lat")]))
    table = _features_sql()
    scan = f"""{det}, w AS (SELECT det_id, fid, frp, uuid, printf('POINT (%.5f %.5f)', lon, lat) AS gmtco_point FROM det)
SELECT {{}}, TRY_CAST(regexp_extract(gmtco_point, '{point}', 1) AS DOUBLE) AS lon, TRY_CAST(regexp_extract(gmtco_point, '{point}', 2) AS DOUBLE) AS lat FROM w"""
    boundary = ", ".join(f"({n}, {k}, {x + 10 * n!r}e0, {y!r}e0)" for n in (0, 1) for k, (x, y) in enumerate(RING))
    # Snyder (1987), equations 8-9 to 8-15, WGS-84.
    e2, a = 0.0066943799901413165, 6378137.0
    ep2 = e2 / (1 - e2)
    arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    lit = lambda v: repr(v) if "e" in repr(v) else f"{v!r}e0"
    snyder = f"""{det}, p AS (SELECT det_id, radians(lat) AS phi, radians(lon + 105) AS lam FROM det),
q AS (SELECT *, tan(phi) ** 2 AS t, {lit(ep2)} * cos(phi) ** 2 AS c, lam * cos(phi) AS a, {lit(a)} / sqrt(1 - {lit(e2)} * sin(phi) ** 2) AS n,
  {lit(a)} * ({lit(arc[0])} * phi - {lit(arc[1])} * sin(2 * phi) + {lit(arc[2])} * sin(4 * phi) - {lit(arc[3])} * sin(6 * phi)) AS m FROM p)
SELECT det_id, round(500000e0 + 0.9996e0 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - {lit(58 * ep2)}) * a ** 5 / 120), 2) AS easting,
  round(0.9996e0 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - {lit(330 * ep2)}) * a ** 6 / 720)), 2) AS northing FROM q"""
    xs, ys = [p[0] for p in RING], [p[1] for p in RING]
    return {
        "detections_scan": f"""{det}, w AS (SELECT det_id, frp, printf('POINT (%.5f %.5f)', lon, lat) AS gmtco_point FROM det)
SELECT det_id, gmtco_point, TRY_CAST(regexp_extract(gmtco_point, '{point}', 1) AS DOUBLE) AS lon, TRY_CAST(regexp_extract(gmtco_point, '{point}', 2) AS DOUBLE) AS lat, frp FROM w""",
        "csv_scan": scan.format("det_id, gmtco_point, fid, frp, uuid"),
        "site_point": f"{det} SELECT det_id, CASE WHEN det_id % 7 > 1 THEN round(lon, 5) WHEN det_id % 3 > 0 THEN round(lat, 5) END AS lon, "
                      "CASE WHEN det_id % 7 > 1 THEN round(lat, 5) WHEN det_id % 3 > 0 THEN round(lon, 5) END AS lat FROM det",
        "outline_file": f"SELECT CAST(c0 AS INTEGER) AS poly_id, CAST(c1 AS INTEGER) AS corner, c2 AS lon, c3 AS lat FROM (VALUES {boundary}) v(c0, c1, c2, c3)",
        "utm_coordinates": snyder,
        "annotated_csv": _members_sql(where=_inside_sql()) + " SELECT d.det_id, d.frp, m.cluster_id FROM det d LEFT JOIN m ON m.det_id = d.det_id",
        "centroid_csv": table + " SELECT centroid_lat AS latitude, centroid_lon AS longitude FROM c",
        "valid_clusters": _members_sql() + """ SELECT det_id, cluster_id FROM m WHERE cluster_id IN
(SELECT cluster_id FROM m GROUP BY cluster_id HAVING count(*) >= (SELECT floor(count(DISTINCT fid) * 0.1e0) FROM det))""",
        "distinct_collects": f"""{det} SELECT n AS num_collects, CAST(floor(n * 0.01e0) AS BIGINT) AS num_valid FROM
(SELECT count(DISTINCT fid) + coalesce(max(CASE WHEN fid IS NULL THEN 1 ELSE 0 END), 0) AS n FROM det)""",
        "in_bounds": f"{det} SELECT det_id, lon, lat FROM det WHERE {_inside_sql()}",
        "out_of_bounds": f"{det} SELECT det_id, lon, lat FROM det WHERE NOT ({_inside_sql()})",
        "heatmap_kernel": f"WITH {kernel} SELECT CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, round(w, 12) AS weight FROM k",
        "heatmap_cells": f"""{det}, {kernel}, box AS (SELECT min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, max(lat) AS lat1 FROM det),
s AS (SELECT CAST(floor((lat1 - lat) / 0.006e0) AS BIGINT) + dy AS "row", CAST(floor((lon - lon0) / 0.006e0) AS BIGINT) + dx AS col, w FROM det, box, k)
SELECT "row", col, round(sum(w), 9) AS weight FROM s, box WHERE "row" BETWEEN 0 AND floor((lat1 - lat0) / 0.006e0) AND col BETWEEN 0 AND floor((lon1 - lon0) / 0.006e0) GROUP BY "row", col""",
        "eps_neighbor_counts": _labels_sql() + " SELECT a AS det_id, count(*) AS neighbours FROM pairs GROUP BY a",
        "core_points": _labels_sql() + " SELECT det_id FROM core",
        "dbscan_labels": _labels_sql() + " SELECT det_id, label FROM labels",
        "dbscan_noise": _labels_sql() + " SELECT det_id FROM labels WHERE label = -1",
        "cluster_membership": _members_sql() + " SELECT det_id, cluster_id FROM m",
        "cluster_centroids": table + " SELECT cluster_id, centroid_lon, centroid_lat, num_in_cluster FROM c",
        "cluster_distances": table + " SELECT det_id, cluster_id, round(distance, 3) AS distance FROM g",
        "cluster_spatial_stats": table + " SELECT cluster_id, " + ", ".join(f"round(distance_{n}, 3) AS distance_{n}" for n in ("mean", "stddev", "max", "min")) + " FROM ds",
        "cluster_intensity_stats": table + " SELECT cluster_id, num_in_cluster, intensity_mean, round(intensity_stddev, 6) AS intensity_stddev, intensity_max, intensity_min FROM t",
        "cluster_bbox": table + " SELECT cluster_id, min_lon, min_lat, max_lon, max_lat FROM bx",
        "cluster_polygon_ring": table + " " + ring,
        "cluster_features": table + f" SELECT cluster_id, num_in_cluster, {_shown_sql()} FROM t",
        "cluster_predictions": table + f" SELECT cluster_id, name, num_collects, num_in_cluster, 'flare' AS signal_type, centroid_lon, centroid_lat, {_shown_sql()}, model_prediction FROM t",
        "geojson_points": table + " SELECT name, cluster_id, num_in_cluster, model_prediction, 'Point' AS kind, centroid_lon AS lon, centroid_lat AS lat FROM t",
        "geojson_polygons": table + " SELECT name, cluster_id, 'Polygon' AS kind, CAST(5 AS BIGINT) AS corners, min_lon, min_lat, max_lon, max_lat FROM t",
        "hierarchical_clusters": _members_sql(4, least=1) + " SELECT det_id, cluster_id FROM m",
        "annotated_rows": _members_sql(where=_inside_sql()) + " SELECT d.det_id, d.frp, m.cluster_id FROM det d LEFT JOIN m ON m.det_id = d.det_id",
        "order_property": _members_sql() + " SELECT cluster_id, min_by(uuid, det_id) AS \"order\" FROM m GROUP BY cluster_id",
        "outline_midpoint": f"SELECT CAST(0 AS BIGINT) AS poly_id, ({min(xs)!r}e0 + {max(xs)!r}e0) / 2 AS lon, ({min(ys)!r}e0 + {max(ys)!r}e0) / 2 AS lat",
    }

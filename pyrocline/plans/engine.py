"""Whole runs: density and mixture engines over one table of detections."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocline.config import Settings
from pyrocline.operators import bounds, clusters, density, mixture, raster, scoring
from pyrocline.sources import geotiff, sinks
from pyrocline.sources.outline import Ring
from pyrocline.storage import settle

log = logging.getLogger("pyrocline")


@dataclass
class Run:
    """Located detections (det_id, lon, lat, frp, fid, perhaps uuid) under ``settings`` within ``rings``.

    Collects and the heat map count all rows; clusters and their statistics the rows in bounds.
    """

    rows: DataFrame
    rings: list[Ring] = field(default_factory=list)
    settings: Settings = Settings()

    @property
    def spark(self) -> SparkSession:
        """The rows' session."""
        return self.rows.sparkSession

    def bounded(self) -> DataFrame:
        """All rows with ``in_bounds``."""
        return bounds.with_in_bounds(self.rows, self.rings)

    def inside(self) -> DataFrame:
        """Rows in bounds."""
        return self.bounded().where("in_bounds").drop("in_bounds")

    def outside(self) -> DataFrame:
        """Rows out of bounds."""
        return self.bounded().where("NOT in_bounds").drop("in_bounds")

    def collects(self) -> DataFrame:
        """Distinct collects and the validity threshold."""
        return clusters.distinct_collects(self.rows, self.settings.valid_share)

    def heatmap(self) -> DataFrame:
        """Heat map cells of all rows."""
        return raster.heatmap(self.rows, self.settings.pixel)

    def labels(self) -> DataFrame:
        """Density labels of the rows in bounds."""
        return density.cluster(self.inside(), self.settings.eps, self.settings.min_samples)

    def members_of(self, labels: DataFrame, min_members: int | None = None) -> DataFrame:
        """Rows in bounds that belong to a kept cluster, with ``cluster_id``."""
        kept = clusters.membership(labels, min_members or self.settings.min_members)
        if self.settings.apply_valid_share:
            least = self.collects().first().num_valid
            full = kept.groupBy("cluster_id").count().where(F.col("count") >= least).select("cluster_id")
            kept = kept.join(full, "cluster_id", "left_semi")
        return self.inside().join(kept, "det_id")

    def members(self) -> DataFrame:
        """Members of the density clusters, as a stored table."""
        return settle(self.members_of(self.labels()), "members")

    def hierarchical(self) -> DataFrame:
        """Members of single-linkage clusters at distance ``pixel`` with more than three points."""
        return self.members_of(density.cluster(self.inside(), self.settings.pixel, 1), 4)

    def mixture(self) -> tuple[mixture.Mixture, DataFrame]:
        """A mixture with a component for each single-linkage cluster, started from it, and the rows in bounds it was fitted to."""
        inside = settle(self.inside(), "inside")
        return mixture.fit_pieces(inside, density.cluster(inside, self.settings.pixel, 1)), inside

    def mixture_members(self) -> tuple[DataFrame, mixture.Mixture]:
        """Members by the likeliest component of the mixture."""
        model, inside = self.mixture()
        return self.members_of(mixture.assign(model, inside)), model

    def classified(self, members: DataFrame, model: scoring.Linear | None, base: str = "detections") -> DataFrame:
        """Cluster table with statistics, properties and, with a model, predictions."""
        table = clusters.properties(clusters.features(members), self.collects(), base, self.settings.signal_type)
        return scoring.predict(table, model) if model else table

    def write(self, folder: str, source: str, model: scoring.Linear | None) -> dict[str, str]:
        """Write points, polygons and heat map below ``folder`` and return their paths."""
        paths = sinks.output_paths(folder, source)
        cells, box = settle(self.heatmap(), "heatmap"), raster.extent(self.rows.where("lon IS NOT NULL AND lat IS NOT NULL"))
        sinks.write_heatmap(cells, box, self.settings.pixel, paths["heatmap"])
        geotiff.write_geotiff(cells, box, self.settings.pixel, paths["heatmap"] + ".tif")
        table = settle(self.classified(self.members(), model, paths["base"]), "clusters")
        sinks.write_collection(sinks.point_features(table), paths["points"])
        sinks.write_collection(sinks.polygon_features(table), paths["polygons"])
        total = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("num_in_cluster"), F.lit(0)).alias("m")).first()
        log.info("%d clusters with %d detections", total.n, total.m)
        return paths

    def write_hierarchical(self, folder: str, source: str) -> str:
        """Write the polygons of the single-linkage clusters and return their path."""
        paths = sinks.output_paths(folder, source)
        table = self.classified(settle(self.hierarchical(), "hierarchical"), None, paths["base"])
        sinks.write_collection(sinks.polygon_features(table), paths["hierarchical"])
        return paths["hierarchical"]

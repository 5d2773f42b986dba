"""Gaussian mixtures as an alternative to density clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyrocline.operators import ellipses
from pyrocline.storage import forget, settle

#: Up to this many points one task makes all rounds, which takes less than a job for each round.
FEW_POINTS = 100_000
#: About so many points are a task's in each round.
TASK_POINTS = 100_000
_FOUND = "component long, share double, x double, y double, xx double, xy double, yy double"
_PLACED = "abs(lon) < double('infinity') AND abs(lat) < double('infinity')"


def _vectors(points: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["lon", "lat"], outputCol="place", handleInvalid="skip").transform(points.where("lon IS NOT NULL AND lat IS NOT NULL"))


@dataclass(frozen=True)
class Mixture:
    """Weights, means (lon, lat) and covariances of the components."""

    weights: tuple[float, ...] | np.ndarray
    centres: tuple[tuple[float, float], ...] | np.ndarray
    spreads: tuple[np.ndarray, ...] | np.ndarray

    def forms(self) -> ellipses.Forms:
        """The components' forms."""
        return ellipses.forms(*(np.array(x, float) for x in (self.weights, self.centres, self.spreads)))


def fit(points: DataFrame, components: int, seed: int = 42, rounds: int = 100) -> Mixture:
    """A mixture of ``components`` over lon and lat by expectation maximisation; a single one is the points' own mean and covariance."""
    rows = _vectors(points)
    if components > 1:
        found = GaussianMixture(k=components, seed=seed, maxIter=rounds, tol=1e-6, featuresCol="place").fit(rows)
        return Mixture(tuple(found.weights), tuple((float(g.mean[0]), float(g.mean[1])) for g in found.gaussians), tuple(g.cov.toArray() for g in found.gaussians))
    lon, lat, xx, xy, yy = (x or 0.0 for x in rows.agg(F.avg("lon"), F.avg("lat"), F.var_pop("lon"), F.covar_pop("lon", "lat"), F.var_pop("lat")).first())
    return Mixture((1.0,), ((lon, lat),), (np.array([[xx, xy], [xy, yy]]),))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("lon", "lat"))


def _rows(found: np.ndarray, *more: tuple[int, float]) -> pa.RecordBatch:
    """Components that have a share, and further rows of a number and a value."""
    kept = np.flatnonzero(found[:, 0])
    table = np.concatenate([found[kept], [[x, 0, 0, 0, 0, 0] for _, x in more]]) if more else found[kept]
    columns = [pa.array(np.concatenate([kept, [n for n, _ in more]]).astype(np.int64)), *map(pa.array, table.T.copy())]
    return pa.record_batch(columns, ["component", "share", "x", "y", "xx", "xy", "yy"])


def _table(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The first column and the others of a small table."""
    rows = found.toArrow()
    return rows.column(0).to_numpy(), np.stack([rows.column(n).to_numpy() for n in rows.column_names[1:]], axis=1).astype(float)


def _at_once(points: DataFrame, start: ellipses.Parameters, rounds: int, tol: float) -> ellipses.Parameters:
    """All rounds in one task."""
    held = points.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_arrays(batch) for batch in batches if batch.num_rows]
        if not parts:
            return
        lon, lat = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lat, lon))
        lon, lat, count = lon[order], lat[order], len(held.value[0])

        def expect(of: ellipses.Forms) -> tuple[np.ndarray, float]:
            found = np.zeros((count, 6))
            return found, ellipses.sums(lon, lat, of, found)

        weights, centres, spreads = ellipses.maximise(held.value, expect, rounds, tol)
        yield _rows(np.column_stack([np.maximum(weights, np.finfo(float).tiny), centres, spreads[:, 0], spreads[:, 1, 1]]))

    order, found = _table(points.select("lon", "lat").coalesce(1).mapInArrow(run, _FOUND))
    held.destroy()
    found = found[np.argsort(order)]
    return found[:, 0], found[:, 1:3], found[:, [3, 4, 4, 5]].reshape(-1, 2, 2)


def _by_rounds(points: DataFrame, start: ellipses.Parameters, count: int, rounds: int, tol: float) -> ellipses.Parameters:
    """A job for each round; points are stored in order of their place, so that a batch meets few components."""
    context = points.sparkSession.sparkContext
    west, south, east, north = points.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    side = max((north - south) * (east - west) * ellipses.BLOCK / count, 0.0) ** 0.5 or 1.0
    strips = points.select(F.floor((F.col("lat") - F.lit(south)) / F.lit(side)).alias("strip"), "lon", "lat")
    tasks = max(3 * context.defaultParallelism, -(-count // TASK_POINTS))
    stored = settle(strips.repartitionByRange(tasks, "strip", "lon").sortWithinPartitions("strip", "lon", "lat").select("lon", "lat"), "places")

    def expect(of: ellipses.Forms) -> tuple[np.ndarray, float]:
        held = context.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, level = np.zeros((len(held.value.base), 6)), 0.0
            for batch in batches:
                if batch.num_rows:
                    level += ellipses.sums(*_arrays(batch), held.value, found)
            yield _rows(found, (-1, level))

        which, parts = _table(stored.mapInArrow(run, _FOUND))
        held.destroy()
        own = which >= 0
        found = np.zeros((len(of.base), 6))
        np.add.at(found, which[own], parts[own])
        return found, float(parts[~own, 0].sum())

    found = ellipses.maximise(start, expect, rounds, tol)
    forget(stored)
    return found


def fit_pieces(points: DataFrame, labels: DataFrame, rounds: int = 100, tol: float = 1e-6, few_points: int = FEW_POINTS) -> Mixture:
    """A mixture with a component for each label (``det_id, label``) from 0 up, by expectation maximisation from the labelled points' shares, means and covariances.

    Points without a place or a label aren't part of the start; those without a
    place aren't fitted. Components are in the order of the labels. Rounds end
    when the log-likelihood changes by at most ``tol``. Every point counts in
    every round, with all components but those whose shares vanish in rounding.
    """
    placed = points.select("det_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).where(_PLACED)
    pieces = placed.join(labels.where("label >= 0").select("det_id", "label").hint("merge"), "det_id").groupBy("label").agg(
        F.count("*"), F.avg("lon"), F.avg("lat"), F.var_pop("lon"), F.covar_pop("lon", "lat"), F.var_pop("lat"))
    order, found = _table(pieces)
    if len(order) < 2:
        return fit(points, 1)
    found = found[np.argsort(order)]
    start = (found[:, 0] / found[:, 0].sum(), found[:, 1:3], ellipses.steadied(found[:, [3, 4, 4, 5]].reshape(-1, 2, 2)))
    count = placed.count()
    return Mixture(*(_at_once(placed, start, rounds, tol) if count <= few_points else _by_rounds(placed, start, count, rounds, tol)))


def _best(part: ellipses.Part) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``part.rows`` and their likeliest components, of several the first."""
    top = np.zeros(len(part.rows))
    np.maximum.at(top, part.at, part.share)
    likeliest = part.share == top[part.at]
    first = np.full(len(part.rows), np.iinfo(np.int64).max)
    np.minimum.at(first, part.at[likeliest], part.own[likeliest])
    return np.arange(len(part.rows)), first


def _by_batch(model: Mixture, points: DataFrame, more: list[T.StructField], columns: Callable[[ellipses.Part], tuple[np.ndarray, ...]], cut: float) -> DataFrame:
    """``det_id`` and what ``columns`` makes of a part's shares: places in its rows, then the columns ``more``."""
    placed = points.select("det_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).where(_PLACED)
    held = points.sparkSession.sparkContext.broadcast(model.forms())
    names = ["det_id", *(f.name for f in more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ellipses.shares(*_arrays(batch), held.value, cut) if batch.num_rows else ():
                at, *values = columns(part)
                yield pa.record_batch([batch.column("det_id").take(pa.array(part.rows[at])), *map(pa.array, values)], names)

    return placed.mapInArrow(run, T.StructType([placed.schema["det_id"], *more]))


def assign(model: Mixture, points: DataFrame) -> DataFrame:
    """``det_id, label``: the likeliest component of each point with a place, of several the first."""
    return _by_batch(model, points, [T.StructField("label", T.LongType())], _best, ellipses.CUT)


def assign_soft(model: Mixture, points: DataFrame, least: float = 0.4) -> DataFrame:
    """``det_id, label, probability``: every component whose posterior is above ``least``; a point may have none, one or two."""

    def above(part: ellipses.Part) -> tuple[np.ndarray, ...]:
        kept = part.share > least
        return part.at[kept], part.own[kept], part.share[kept]

    more = [T.StructField("label", T.LongType()), T.StructField("probability", T.DoubleType())]
    return _by_batch(model, points, more, above, ellipses.CUT if least > np.exp(-ellipses.CUT) else np.inf)


def means(model: Mixture) -> list[tuple[int, float, float]]:
    """(component, longitude, latitude) of the components' means."""
    return [(n, float(lon), float(lat)) for n, (lon, lat) in enumerate(model.centres)]

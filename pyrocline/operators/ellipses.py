"""Shares of Gaussian components in points of the plane, and rounds of expectation maximisation, in numpy.

A component is compared only with the points in the box of its ellipse. The
ellipse is as wide as it takes for everything left out to be below ``exp(-cut)``
of the point's density: the level that this supposes is checked afterwards, and
points that lie below it are done again with a lower one. With the usual cut a
million components left out change nothing that a double can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

#: Logarithm of the share, turned round, below which a component of a point is left out.
CUT = 50.0
#: Square degrees; below it a component's spread counts as this.
LEAST_VARIANCE = 1e-18
#: Square degrees added to each variance in a round, as scikit-learn does: components of a single place keep a density.
STEADY_VARIANCE = 1e-6
#: Points that are looked at together, and the most pairs with components that are held at once.
BLOCK, MOST_PAIRS = 8_192, 400_000


class Forms(NamedTuple):
    """Components, an array for each part: means, inverse covariances, logarithmic heights, deviations along the axes."""

    lon: np.ndarray
    lat: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    base: np.ndarray
    wide: np.ndarray
    high: np.ndarray


def forms(weights: np.ndarray, centres: np.ndarray, spreads: np.ndarray) -> Forms:
    """Forms of components; each covariance is inverted once, its eigenvalues held above ``LEAST_VARIANCE``."""
    values, vectors = np.linalg.eigh(spreads)
    values = np.maximum(values, LEAST_VARIANCE)
    inverse = np.einsum("kij,kj,klj->kil", vectors, 1 / values, vectors)
    spread = np.einsum("kij,kj,klj->kil", vectors, values, vectors)
    base = np.log(np.maximum(weights, np.finfo(float).tiny)) - 0.5 * np.log(values).sum(axis=1)
    return Forms(centres[:, 0].copy(), centres[:, 1].copy(), inverse[:, 0, 0].copy(), inverse[:, 0, 1].copy(), inverse[:, 1, 1].copy(), base,
                 np.sqrt(spread[:, 0, 0]), np.sqrt(spread[:, 1, 1]))


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``counts`` of them, one after another."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _pairs(lon: np.ndarray, lat: np.ndarray, of: Forms, floor: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of points and components, by component, with every pair whose logarithm is above ``floor``; None if there are too many for one go."""
    reach = np.sqrt(np.maximum(2 * (of.base - floor), 0)) * (1 + 1e-9)
    west, south, east, north = lon.min(), lat.min(), lon.max(), lat.max()
    dx, dy = reach * of.wide, reach * of.high
    own = np.flatnonzero((of.base >= floor) & (of.lon + dx >= west) & (of.lon - dx <= east) & (of.lat + dy >= south) & (of.lat - dy <= north))
    # Points lie in strips from south to north, in a strip from west to east: a box is a range of each strip that it touches.
    width, height = east - west or 1.0, north - south or 1.0
    strips = int(np.clip(np.sqrt(len(lon) * height / width), 1, len(lon)))
    key = np.minimum((lat - south) / height * strips, strips - 1).astype(np.int64) + 0.5 * (lon - west) / width
    order = np.argsort(key, kind="stable")
    key = key[order]
    x, y, dx, dy = of.lon[own], of.lat[own], dx[own], dy[own]
    low, top = (np.clip(np.floor((edge - south) / height * strips + slack), 0, strips - 1).astype(np.int64) for edge, slack in ((y - dy, -1e-6), (y + dy, 1e-6)))
    if (top - low + 1).sum() > MOST_PAIRS and len(lon) > 1:
        return None
    counts = top - low + 1
    strip, box = _ranges(low, counts), np.repeat(np.arange(len(own)), counts)
    left, right = (np.clip((edge - west) / width, 0, 1) * 0.5 for edge in (x - dx, x + dx))
    begin = np.searchsorted(key, strip + left[box] - 1e-6)
    counts = np.searchsorted(key, strip + right[box] + 1e-6, side="right") - begin
    if counts.sum() > MOST_PAIRS and len(lon) > 1:
        return None
    return order[_ranges(begin, counts)], np.repeat(own[box], counts)


class Part(NamedTuple):
    """Points (positions), the logarithms of their densities, and pairs by component: place in ``rows``, component, share."""

    rows: np.ndarray
    level: np.ndarray
    at: np.ndarray
    own: np.ndarray
    share: np.ndarray


def shares(lon: np.ndarray, lat: np.ndarray, of: Forms, cut: float = CUT) -> Iterator[Part]:
    """All points in parts, each point in one of them."""
    blocks = [np.arange(n, min(n + BLOCK, len(lon))) for n in range(0, len(lon), BLOCK)]
    todo = [(rows, float(np.median(of.base)) - 12.0, 16.0) for rows in reversed(blocks)]
    while todo:
        rows, least, step = todo.pop()
        x, y = lon[rows], lat[rows]
        found = _pairs(x, y, of, least - cut)
        if found is None:
            rows = rows[np.argsort(x if np.ptp(x) > np.ptp(y) else y, kind="stable")]
            todo += [(rows[len(rows) // 2:], least, step), (rows[: len(rows) // 2], least, step)]
            continue
        at, own = found
        dx, dy = x[at] - of.lon[own], y[at] - of.lat[own]
        logs = of.base[own] - 0.5 * (of.xx[own] * dx * dx + 2 * of.xy[own] * dx * dy + of.yy[own] * dy * dy)
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, at, logs)
        share = np.exp(logs - top[at])
        total = np.bincount(at, share, len(rows))
        with np.errstate(divide="ignore"):
            level = top + np.log(total)
        good = level >= least if least > -1e300 else np.full(len(rows), True)
        if not good.all():
            todo.append((rows[~good], least - step, step * 4))
            kept, place = good[at], np.cumsum(good) - 1
            at, own, share, total = place[at[kept]], own[kept], share[kept], total[good]
            rows, level = rows[good], level[good]
        yield Part(rows, level, at, own, share / total[at])


def sums(lon: np.ndarray, lat: np.ndarray, of: Forms, into: np.ndarray) -> float:
    """Add each component's shares to ``into``: their sum, and by them the sums of dx, dy, dx dx, dx dy, dy dy from its mean; returns the points' log-likelihood."""
    found = 0.0
    for part in shares(lon, lat, of):
        found += float(part.level.sum())
        if not len(part.own):
            continue
        starts = np.flatnonzero(np.diff(part.own, prepend=-1))
        dx, dy = lon[part.rows][part.at] - of.lon[part.own], lat[part.rows][part.at] - of.lat[part.own]
        own, x, y = part.own[starts], part.share * dx, part.share * dy
        for column, values in enumerate((part.share, x, y, x * dx, x * dy, y * dy)):
            into[own, column] += np.add.reduceat(values, starts)
    return found


Parameters = tuple[np.ndarray, np.ndarray, np.ndarray]


def steadied(spreads: np.ndarray) -> np.ndarray:
    """Covariances with ``STEADY_VARIANCE`` added."""
    return spreads + STEADY_VARIANCE * np.eye(2)


def _maximised(was: Parameters, found: np.ndarray) -> Parameters:
    """Weights, means and covariances from sums; a component without a share keeps its place with no weight."""
    has = found[:, 0] > 1e-250
    part = found / np.where(has, found[:, 0], 1.0)[:, None]
    x, y = part[:, 1], part[:, 2]
    spreads = steadied(np.stack([part[:, 3] - x * x, part[:, 4] - x * y, part[:, 4] - x * y, part[:, 5] - y * y], axis=1).reshape(-1, 2, 2))
    return (found[:, 0] / found[:, 0].sum(), np.where(has[:, None], was[1] + part[:, 1:3], was[1]), np.where(has[:, None, None], spreads, was[2]))


def maximise(start: Parameters, expect: Callable[[Forms], tuple[np.ndarray, float]], rounds: int, tol: float) -> Parameters:
    """Rounds until the log-likelihood changes by ``tol`` at most; ``expect`` gives the sums over all points and their log-likelihood."""
    now, level = start, -np.inf
    for _ in range(rounds):
        found, new = expect(forms(*now))
        now = _maximised(now, found)
        if abs(new - level) <= tol:
            break
        level = new
    return now

"""Isotonic calibration: a rising curve from raw scores to the share of label 1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level blocks that a fitted curve keeps; closest neighbours are merged beyond it.
MAX_BLOCKS = 24
#: Share of the score that goes on rising where the fitted curve is level, so that order is kept.
SLOPE = 0.01


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float, float, float]]:
    """(first x, last x, mean y, weight) of the least-squares rising step curve, by pooling adjacent violators.

    Equal x are pooled first; rows with NaN are ignored.
    """
    ok = ~np.isnan(x)
    values, at = np.unique(x[ok], return_inverse=True)
    weight = np.bincount(at, minlength=len(values)).astype(float)
    total = np.bincount(at, y[ok].astype(float), minlength=len(values))
    blocks: list[list[float]] = []
    for v, w, t in zip(values.tolist(), weight.tolist(), total.tolist(), strict=True):
        blocks.append([v, v, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, t2, w2 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + t2, blocks[-1][3] + w2]
    return [(a, b, t / w, w) for a, b, t, w in blocks]


@dataclass(frozen=True)
class Isotonic:
    """Rising curve through ``knots`` (x, y), straight between them, level outside."""

    knots: tuple[tuple[float, float], ...]
    scale: float

    def values(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1."""
        xs, ys = zip(*self.knots, strict=True)
        level = np.interp(x, xs, ys)
        return (1 - SLOPE) * level + SLOPE * (0.5 + np.arctan(np.asarray(x) / self.scale) / np.pi)

    def column(self, name: str) -> Column:
        """The same as a Spark expression."""
        level = F.lit(self.knots[0][1])
        for (a, u), (b, v) in zip(self.knots, self.knots[1:], strict=False):
            if b > a and v > u:
                level = level + (F.least(F.greatest(F.col(name), F.lit(a)), F.lit(b)) - a) * ((v - u) / (b - a))
        return F.least(F.lit(1.0), (1 - SLOPE) * level + SLOPE * (0.5 + F.atan(F.col(name) / self.scale) / np.pi))


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Curve fitted to raw scores ``x`` and labels ``y`` (0 or 1); without rows the score is level at 0."""
    blocks = pool_adjacent(np.asarray(x, float), np.asarray(y, float))
    if not blocks:
        return Isotonic(((0.0, 0.0),), 1.0)
    while len(blocks) > MAX_BLOCKS:
        k = min(range(len(blocks) - 1), key=lambda i: (blocks[i + 1][2] - blocks[i][2]) * min(blocks[i][3], blocks[i + 1][3]))
        (a, _, u, w), (_, b, v, z) = blocks[k], blocks[k + 1]
        blocks[k:k + 2] = [(a, b, (u * w + v * z) / (w + z), w + z)]
    spread = float(np.nanstd(x)) or 1.0
    return Isotonic(tuple(p for a, b, m, _ in blocks for p in ([(a, m), (b, m)] if b > a else [(a, m)])), spread)

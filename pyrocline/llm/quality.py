"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

A Gaussian kernel between documents' statistics is approximated by random
Fourier features (Rahimi & Recht 2007), drawn with a fixed seed. Ridge scores
come from the normal equations: each task sums the outer products of its own
rows, the sums are added up cell by cell in a shuffle, and the driver solves one
system whose size depends on the number of features alone. Isotonic calibration
uses labelled rows that the equations don't contain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocline.llm.calibration import Isotonic, fit_isotonic
from pyrocline.llm.common import crc_of_id, text_bytes, with_label
from pyrocline.storage import settle

#: Labels are learned where crc32(doc_id) mod HOLD_OF is not HOLD_AT.
HOLD_OF, HOLD_AT = 5, 0
#: Of the rows learned from, those with (crc32 div HOLD_OF) mod CALIBRATE_OF = 0 calibrate.
CALIBRATE_OF = 4
#: At most about this many labelled rows are learned from, chosen by a hash of the id.
LABELLED_ROWS = 400_000
FEATURES = 256
#: Kernel exp(-GAMMA * squared distance) of standardised statistics; ridge penalty for each row.
GAMMA, RIDGE = 0.05, 1e-4
THRESHOLD = 0.3
SEED = 42
#: Standardised statistics are held within this many deviations.
CLIP = 6.0

STATISTICS = ("log_bytes", "letters", "upper", "digits", "spaces", "stops", "symbols", "beyond_ascii", "word_bytes", "word_spread",
              "distinct_words", "top_word", "distinct_lines", "line_words", "repeats", "capital_words", "ended_lines", "bare_marks", "marked_words")

_CLASSES = np.zeros((256, 7))
for _code in range(256):
    _char = chr(_code)
    _CLASSES[_code, 0 if _code < 128 and _char.isalpha() else 2 if _char.isdigit() and _code < 128 else 3 if _char in " \t\n\r\v\f" else 4 if _char in ".,;:'\"?-" else 6 if _code >= 128 else 5] = 1
    if _code < 128 and _char.isupper():
        _CLASSES[_code, 1] = 1
_BARE = frozenset(b"!#$%&*+/<=>@\\^_`|~")


def statistics_of(text: bytes) -> list[float]:
    """The numbers named by STATISTICS for a whole UTF-8 text; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, count = len(text), len(words)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / size).tolist()
    lengths = np.fromiter(map(len, words), np.int64, count)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words, words[1:])) if count > 1 else 0
    return [
        float(np.log1p(size)), *shares, float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        float(np.log(len(seen)) / np.log(count)) if count > 1 else 1.0, max(seen.values()) / count, len(set(lines)) / len(lines), float(np.log1p(count / len(lines))),
        again / count, sum(map(bytes.isupper, words)) / count, sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines) / len(lines),
        sum(len(w) == 1 and w[0] in _BARE for w in words) / count, sum(w[-1] in _BARE for w in words) / count,
    ]


def _matrix(bodies: pa.Array) -> np.ndarray:
    return np.array([statistics_of(x.as_buffer().to_pybytes()) for x in bodies], float).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Kernel:
    """Standardisation and the random directions."""

    mean: np.ndarray
    spread: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features of statistics, with a constant in front."""
        draw = np.random.default_rng(SEED)
        turn = draw.normal(size=(len(STATISTICS), FEATURES)) * np.sqrt(2 * GAMMA)
        phase = draw.uniform(0, 2 * np.pi, FEATURES)
        level = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        return np.hstack([np.ones((len(stats), 1)), np.sqrt(2 / FEATURES) * np.cos(level @ turn + phase)])


@dataclass(frozen=True)
class Model:
    """Kernel, ridge weights and calibration."""

    kernel: Kernel
    weights: np.ndarray
    scale: Isotonic

    def raw(self, bodies: pa.Array) -> np.ndarray:
        """Uncalibrated scores of UTF-8 texts."""
        return self.kernel.features(_matrix(bodies)) @ self.weights


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``calibrates, label, stats`` of the labelled rows to learn from, as a stored table."""
    crc = crc_of_id()
    known = with_label(docs.select("doc_id", text_bytes().alias("body")).where(crc % HOLD_OF != HOLD_AT), labels, "quality")
    rows = known.select("label").count()
    if rows > LABELLED_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (LABELLED_ROWS << 20) // rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array(_matrix(batch.column("body")).tolist(), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("calibrates"), batch.column("label"), stats], names=["calibrates", "label", "stats"])

    part = (F.floor(crc / HOLD_OF) % CALIBRATE_OF == 0).alias("calibrates")
    rows_in = known.select(part, F.least("label", F.lit(1)).cast("int").alias("label"), "body")
    return settle(rows_in.mapInArrow(each, "calibrates boolean, label int, stats array<double>"), "statistics")


def _sums(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Upper triangle of the features' and labels' outer products, summed over ``rows``."""
    width = FEATURES + 2
    upper = np.triu_indices(width)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                stats = np.stack(batch.column("stats").to_numpy(zero_copy_only=False))
                own = np.hstack([kernel.features(stats), batch.column("label").to_numpy()[:, None].astype(float)])
                total += own.T @ own
        yield pa.record_batch([pa.array(np.arange(width, dtype=np.int64)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["line", "cells"])

    parts = rows.select("stats", "label").mapInArrow(each, "line long, cells array<double>")
    cells = parts.select("line", F.posexplode("cells").alias("at", "cell")).where("at >= line").groupBy("line", "at").agg(F.sum("cell").alias("cell"))
    out = np.zeros((width, width))
    table = cells.toArrow()
    out[table.column("line").to_numpy(), table.column("at").to_numpy()] = table.column("cell").to_numpy()
    assert len(table) in (0, len(upper[0]))
    return out + np.triu(out, 1).T


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learned from ``labels.quality`` of the rows that aren't held out."""
    known = _labelled(docs, labels)
    fit = known.where("NOT calibrates")
    listed = [F.col("stats")[i] for i in range(len(STATISTICS))]
    shape = fit.agg(*[f(c) for c in listed for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([x or 0.0 for x in shape[::2]])
    spread = np.array([x if x and x > 1e-9 else 1.0 for x in shape[1::2]])
    kernel = Kernel(mean, spread)
    sums = _sums(fit, kernel)
    rows = max(sums[0, 0], 1.0)
    inner = sums[:-1, :-1] + RIDGE * rows * np.diag([0.0, *[1.0] * FEATURES])
    weights = np.linalg.lstsq(inner, sums[:-1, -1], rcond=None)[0]
    own = known.where("calibrates").select("stats", "label").toArrow()  # at most about LABELLED_ROWS / CALIBRATE_OF rows
    if len(own):
        raw = kernel.features(np.stack(own.column("stats").to_numpy())) @ weights
        return Model(kernel, weights, fit_isotonic(raw, own.column("label").to_numpy()))
    return Model(kernel, weights, fit_isotonic(np.zeros(0), np.zeros(0)))


def with_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``__score``: 0 to 1, higher for likelier label 1."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf("double")
    def scores(bodies: pd.Series) -> pd.Series:
        own = model.value
        return pd.Series(own.scale.values(own.raw(pa.array(bodies, pa.binary()))), dtype=float)

    return docs.withColumn("__score", scores(text_bytes()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts and texts of white space alone have statistics 0 and
    the score that goes with them. Null ids are kept (never labelled). Without
    labels every score is about 0. Repeated rows give repeated rows; an empty
    table gives an empty result. Only ``doc_id, text`` and ``labels.doc_id,
    quality`` are read, so other columns may have any name.
    """
    found = with_score(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", (crc_of_id() % HOLD_OF == HOLD_AT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))

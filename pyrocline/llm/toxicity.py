"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary documents, over shared
backoff counts. The shared part is an interpolated Kneser-Ney bigram model of
both classes: absolute discounts, a backoff weight for each context, continuation
counts (in how many contexts a word occurs) below. A class has its own word
probabilities, discounted in proportion to its size and interpolated with the
shared ones, so an expression too rare to tell the classes apart has the same
probability in both and says nothing. They scale the shared bigram model, with an
exact normaliser for each context (Kneser, Peters & Klakow 1997):

    P_class(w | v) = P_shared(w | v) * r_class(w) / Z_class(v),  r_class(w) = P_class(w) / P_shared(w),
    Z_class(v) = sum over w of P_shared(w | v) * r_class(w)

A text's ratio is (log P_toxic - log P_ordinary) / words; P_shared cancels, so what
scoring looks up is log r of each word and log Z of each context. Isotonic
calibration on labelled rows kept out of the models makes it a score from 0 to 1.
No word, pair or ratio is pruned. Class bigram counts backed off separately were
tried and are worse (README): the classes then differ by what their samples
happen to contain, not least by the mix of languages, which Z takes out.

Counts: every labelled row outside the calibration part is counted, whole. Each
task counts its own rows with arrays, and partial counts are summed by a shuffle
on the pair, so no single expression is hot. The tables of counts grow with the
input and stay tables; the words' weights go to the executors while they are at
most ``BROADCAST_WEIGHTS``, else texts' words are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocline.llm.calibration import Isotonic, fit_isotonic
from pyrocline.llm.common import crc_of_id, give_back, packed, small_enough, text_bytes, with_label
from pyrocline.storage import settle

#: Labels are learned where crc32(doc_id) mod HOLD_OF is not HOLD_AT.
HOLD_OF, HOLD_AT = 4, 2
#: Of the rows learned from, those with (crc32 div HOLD_OF) mod CALIBRATE_OF = 0 calibrate; the models count the others.
CALIBRATE_OF = 5
#: Calibration takes about this many rows at most, chosen by a hash of the id.
CALIBRATION_ROWS = 200_000
#: Absolute discounts: of a pair's and a context count in the shared model; of a word's count in the smaller class
#: (in the larger one in proportion to its words).
SHARED_DISCOUNT, CLASS_DISCOUNT = 0.5, 4.0
#: Weight of the shared word probabilities in each class's.
SHARED_WEIGHT = 0.97
THRESHOLD = 0.3
#: Weights that may be sent to every executor, 24 bytes each.
BROADCAST_WEIGHTS = 4_000_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_START = 0
#: Words that a task remembers while scoring.
REMEMBERED = 100_000
#: Bytes of text that a task splits into words at a time while scoring; a longer text goes alone.
SPLIT_BYTES = 1 << 20
#: Distinct bigrams that a task holds before it hands over its counts.
_FLUSH = 2_000_000
#: Bigrams that are sorted at once, and distinct ones that are handed over at once.
_SORTED, _SENT = 1 << 19, 1 << 18


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters, marks and digits."""
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def _word_hash(word: str) -> int:
    """48 bits: of a billion words, one in 140,000 shares another's hash, and pairs travel in 12 bytes."""
    return xxhash.xxh64_intdigest(word) >> 16 | 1  # never _START


class _Ids(dict):
    """Numbers words as they come and keeps their hashes; 0 is the start of a text."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = [_START]

    def __missing__(self, word: str) -> int:
        self.hashes.append(_word_hash(word))
        self[word] = number = len(self.hashes) - 1
        return number


def _summed(ids: _Ids, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    hashes = np.array(ids.hashes, np.int64)
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, n = keys[first], np.add.reduceat(n, first)
    del first
    for at in range(0, len(keys), _SENT):
        some = keys[at:at + _SENT]
        word, prev = hashes[some >> 32], hashes[some >> 1 & (1 << 31) - 1]
        columns = (word << 16 | prev >> 32, prev.astype(np.int32), n[at:at + _SENT] << 1 | some & 1)
        yield pa.record_batch([pa.array(x) for x in columns], names=["high", "low", "packed"])


def count_bigrams(rows: DataFrame) -> DataFrame:
    """``prev, word, toxic, ordinary``: how often word follows prev in each class (hashes; 0: start of text).

    What a task has counted travels as one number, the count and the class; the
    two words' 96 bits go before it as a long and an int. ``rows`` has body
    (binary) and label (1 or 0).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            keys, size = [], 0
            for body, label in zip(batch.column("body"), batch.column("label").to_pylist(), strict=True):
                words = words_of(body.as_buffer().to_pybytes())
                if words:
                    own = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                    keys.append((own << 31 | np.concatenate(([0], own[:-1]))) << 1 | label)
                    size += len(words)
                if size > _SORTED:
                    parts.append(np.unique(np.concatenate(keys), return_counts=True))
                    held += len(parts[-1][0])
                    keys, size = [], 0
            if keys:
                parts.append(np.unique(np.concatenate(keys), return_counts=True))
                held += len(parts[-1][0])
            if held > _FLUSH:
                yield from _summed(ids, parts)
                ids, parts, held = _Ids(), [], 0
        if parts:
            yield from _summed(ids, parts)
        give_back()

    counted = rows.select("body", "label").mapInArrow(each, "high long, low int, packed long")
    # Dealt out before it is summed: the packed rows are smaller than the two sums.
    sums = counted.repartition("high", "low").groupBy("high", "low").agg(
        *[F.sum(F.expr(f"IF(packed & 1 = {c}, packed >> 1, 0)")).alias(name) for c, name in ((1, "toxic"), (0, "ordinary"))])
    prev = F.expr("(high & 65535) << 32 | (low & 4294967295)")
    return sums.select(prev.alias("prev"), F.shiftrightunsigned("high", 16).alias("word"), "toxic", "ordinary")


@dataclass(frozen=True)
class Model:
    """``weights`` (a stored table: word, target, context) and ``unknown``, the target weight of every other word.

    A text's ratio sums each word's target and, of the start and of all words but the last, context.
    """

    weights: DataFrame
    unknown: float


def fit_model(bigrams: DataFrame, discount: float = SHARED_DISCOUNT, class_discount: float = CLASS_DISCOUNT, shared_weight: float = SHARED_WEIGHT) -> Model:
    """The weights by the counts of :func:`count_bigrams`, a stored table; without counts of both classes all are 0."""
    words = settle(bigrams.groupBy("word").agg(F.count("*").alias("kinds"), F.sum("toxic").alias("a"), F.sum("ordinary").alias("b")), "words")
    all_a, all_b, kinds, known = (x or 0 for x in words.agg(F.sum("a"), F.sum("b"), F.sum("kinds"), F.count("*")).first())
    if not all_a or not all_b:
        nothing = words.where("false").select("word", F.lit(0.0).alias("target"), F.lit(0.0).alias("context"))
        return Model(settle(nothing, "weights"), 0.0)
    off = {"a": class_discount * all_a / min(all_a, all_b), "b": class_discount * all_b / min(all_a, all_b)}
    own = {"a": all_a, "b": all_b}
    removed = dict(zip("ab", words.agg(*[F.sum(F.least(F.col(c).cast("double"), F.lit(off[c]))) for c in "ab"]).first(), strict=True))
    rest = {c: (1 - shared_weight) * removed[c] / own[c] + shared_weight for c in "ab"}  # r of a word that the class doesn't tell apart

    # Shared continuation counts, and the shared word probabilities that back off to them.
    low = F.greatest(F.col("kinds") - F.lit(discount), F.lit(0.0)) / kinds + discount * known / kinds / (known + 1)
    one = F.greatest(F.col("a") + F.col("b") - F.lit(discount), F.lit(0.0)) / (all_a + all_b) + discount * known / (all_a + all_b) * F.col("low")
    rated = words.withColumn("low", low).withColumn("one", one)
    rated = rated.select("word", "low", *[((1 - shared_weight) * F.greatest(F.col(c) - F.lit(off[c]), F.lit(0.0)) / (own[c] * F.col("one")) + F.lit(rest[c])).alias(f"r_{c}") for c in "ab"])
    rated = settle(rated, "rated")
    # The sum of low * r over all words, the unknown ones' share included.
    whole = dict(zip("ab", rated.agg(*[F.sum(F.col("low") * F.col(f"r_{c}")) for c in "ab"]).first(), strict=True))
    whole = {c: whole[c] + discount * known / kinds / (known + 1) * rest[c] for c in "ab"}

    # Only words that some class tells apart differ from rest; they are far fewer than the pairs.
    apart = settle(rated.where(" OR ".join(f"abs(r_{c} - {rest[c]!r}D) > 0" for c in "ab")).select("word", "r_a", "r_b"), "apart")
    joined = bigrams.join(F.broadcast(apart) if small_enough(apart) else apart, "word", "left")
    seen = F.greatest(F.col("toxic") + F.col("ordinary") - F.lit(discount), F.lit(0.0))
    backed = F.least(F.col("toxic") + F.col("ordinary"), F.lit(discount))
    z = joined.groupBy("prev").agg(F.sum(F.col("toxic") + F.col("ordinary")).alias("n"), F.sum(backed).alias("backed"),
                                   *[F.sum(seen * F.coalesce(F.col(f"r_{c}"), F.lit(rest[c]))).alias(f"z_{c}") for c in "ab"])
    context = F.ln((F.col("z_b") + F.col("backed") * whole["b"]) / (F.col("z_a") + F.col("backed") * whole["a"]))
    unknown = float(np.log(rest["a"] / rest["b"]))
    weights = z.select(F.col("prev").alias("word"), context.alias("context")).join(apart, "word", "full_outer")
    weights = weights.select("word", F.coalesce(F.ln(F.col("r_a") / F.col("r_b")), F.lit(unknown)).alias("target"), F.coalesce("context", F.lit(0.0)).alias("context"))
    return Model(settle(weights, "weights"), unknown)


class _Scorer:
    """Scores texts by sorted word hashes and their weights; words met are remembered, up to a bound."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, context: np.ndarray, unknown: float) -> None:
        self.keys, self.target, self.context, self.unknown = keys, target, context, unknown
        self.both: dict[str, float] = {}
        self.start = self._weights(np.array([_START]))[1][0]

    def _weights(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.full(len(codes), self.unknown), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        found = self.keys[at] == codes
        return np.where(found, self.target[at], self.unknown), np.where(found, self.context[at], 0.0)

    def ratios(self, texts: Iterable[bytes]) -> list[float]:
        """Mean log ratio of the words of each text, 0 without words; words are held for ``SPLIT_BYTES`` of text at a time."""
        found: list[float] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            if held and size + len(text) > SPLIT_BYTES:
                found += self._ratios(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        return found + self._ratios(held)

    def _ratios(self, texts: list[bytes]) -> list[float]:
        listed = [words_of(x) for x in texts]
        if len(self.both) > REMEMBERED:
            self.both = {}
        new = [w for w in set().union(*listed) if w not in self.both]
        target, context = self._weights(np.fromiter(map(_word_hash, new), np.int64, len(new)))
        self.both.update(zip(new, (target + context).tolist(), strict=True))
        last = self._weights(np.fromiter((_word_hash(x[-1]) if x else 1 for x in listed), np.int64, len(listed)))[1].tolist()
        return [(sum(map(self.both.__getitem__, x)) + self.start - z) / len(x) if x else 0.0 for x, z in zip(listed, last, strict=True)]


def with_ratio(docs: DataFrame, model: Model, limit: int = BROADCAST_WEIGHTS) -> DataFrame:
    """``docs`` (with text) and ``ratio``: the mean log ratio toxic : ordinary of each text's words, 0 without words.

    Up to ``limit`` weights go to the executors; more are joined with the texts' words.
    """
    if small_enough(model.weights, limit):
        table = model.weights.toArrow()
        keys = table.column("word").to_numpy()
        order = np.argsort(keys)
        arrays = (keys[order], table.column("target").to_numpy()[order], table.column("context").to_numpy()[order], model.unknown)
        sent = docs.sparkSession.sparkContext.broadcast(arrays)

        @F.pandas_udf("double")
        def ratios(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = _Scorer(*sent.value)
            for batch in batches:
                yield pd.Series(scorer.ratios(batch), dtype=float)
            give_back()

        return docs.withColumn("ratio", ratios(text_bytes()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["one", "two", "word", "targets", "contexts"]
        for batch in batches:
            for one, two, body in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), batch.column("body"), strict=True):
                words = words_of(body.as_buffer().to_pybytes())
                if words:
                    codes, n = np.unique(np.fromiter(map(_word_hash, words), np.int64, len(words)), return_counts=True)
                    contexts = n - (codes == _word_hash(words[-1]))
                    size = len(n) + 1
                    yield pa.record_batch([pa.array([one] * size, pa.int64()), pa.array([two] * size, pa.int64()), pa.array(np.append(codes, _START)),
                                           pa.array(np.append(n, 0)), pa.array(np.append(contexts, 1))], names=names)

    # The ratio depends on the text alone: rows with the same text add up to the same mean.
    keyed = docs.withColumns({"one": F.xxhash64(F.lit(1), text_bytes()), "two": F.xxhash64(F.lit(2), text_bytes())})
    grams = keyed.select("one", "two", text_bytes().alias("body")).mapInArrow(spread, "one long, two long, word long, targets long, contexts long")
    weighed = grams.join(model.weights, "word", "left").select(
        "one", "two", "targets", (F.col("targets") * F.coalesce("target", F.lit(model.unknown)) + F.col("contexts") * F.coalesce("context", F.lit(0.0))).alias("w"))
    means = weighed.groupBy("one", "two").agg((F.sum("w") / F.sum("targets")).alias("mean"))
    return keyed.join(means, ["one", "two"], "left").withColumn("ratio", F.coalesce("mean", F.lit(0.0))).drop("one", "two", "mean")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, Isotonic]:
    """The model and the calibration, learned from ``labels.toxic`` of the rows that aren't held out."""
    crc = crc_of_id()
    known = with_label(docs.select("doc_id", "text").where(crc % HOLD_OF != HOLD_AT), labels, "toxic").withColumn("label", F.least(F.col("label"), F.lit(1)))
    part = F.floor(crc / HOLD_OF) % CALIBRATE_OF
    model = fit_model(settle(count_bigrams(known.where(part != 0).select(text_bytes().alias("body"), "label")), "bigrams"))
    own = known.where(part == 0)
    rows = own.count()
    if rows > CALIBRATION_ROWS:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (CALIBRATION_ROWS << 20) // rows)
    scored = with_ratio(own.select("text", "label"), model).select("ratio", "label").toArrow()
    return model, fit_isotonic(scored.column("ratio").to_numpy(), scored.column("label").to_numpy())


def with_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, doc_id, text, ratio, score``: ``row`` holds all columns of ``docs``."""
    model, scale = learn(docs, labels)
    return with_ratio(packed(docs), model).withColumn("score", scale.column("ratio"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, ratio`` for each row of ``docs``.

    Null and empty texts have no words: ratio 0, and the score that goes with it.
    Null ids are kept (never labelled, not held out). Without labels of both
    classes every ratio is 0. Repeated rows give repeated rows; an empty table
    gives an empty result. Only ``doc_id, text`` and ``labels.doc_id, toxic``
    are read, so other columns may have any name.
    """
    found = with_score(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", (crc_of_id() % HOLD_OF == HOLD_AT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "ratio")


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns, whatever these are called."""
    return with_score(docs, labels).where(F.col("score") < THRESHOLD).select("row.*")

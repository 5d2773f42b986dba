"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds: the pairs of neighbouring words of each test item, weighted by how rare they
   are: minus the decimal logarithm of their stray occurrences for each word of the
   corpus. Occurrences that go on as the item does don't count, so an item that leaked
   into very many documents keeps its seeds, and a common collocation doesn't pass as
   rare. Pairs above one in ``10 ** LEAST_WEIGHT`` words are no seeds.
2. Join: whole documents are scanned for seeds; hits of one item that lie on nearby
   diagonals make a window. It is aligned if its seeds make up ``SHARE`` of the weight
   of all the item's seeds: where an alignment reaches half of a perfect copy's score,
   a third of the pairs is intact or more. So edited copies need no long intact run.
3. Align: words of window and item are aligned locally; the score is the share
   of a perfect copy's, so it sees edited and paraphrased copies.

The benchmark goes to the executors in blocks of at most ``BLOCK_ITEMS`` items and
about ``BLOCK_BYTES``, the documents pass by each block twice (stray counts, scan); no
pair of tables is joined as a whole, and a passage that a third of all documents
contain costs one alignment in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocline.llm.common import packed, text_bytes
from pyrocline.llm.toxicity import words_of

SEED_WORDS = 2
#: Seeds are pairs rarer than one in 10 ** LEAST_WEIGHT words; items with up to LEAST_SEEDS pairs keep them all.
LEAST_WEIGHT, LEAST_SEEDS = 2.5, 8
#: A window is aligned from this share of the weight of the item's seeds.
SHARE = 0.2
#: Rates are taken over at least so many words: in a smaller corpus all pairs are rare.
LEAST_WORDS = 10_000_000
#: Share of a perfect copy's alignment score from which a document counts as contaminated.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Text that is scanned at once; bounds the arrays that a task holds.
_TOGETHER_BYTES = 4 << 20
HIT = "array<struct<item_id:bigint,score:double,first_word:bigint,words:bigint>>"


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, position in ``window`` where it ends) of two id arrays; id 0 matches nothing.

    Smith & Waterman 1981 with linear gaps, a row at a time: a gap along the row
    is the running maximum of what came before, less the way.
    """
    slope = np.arange(len(window)) * -GAP
    above = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item.tolist() if len(window) else ():
        step = np.where((window == word) & (word > 0), MATCH, MISMATCH)
        row = np.maximum(np.maximum(above[:-1] + step, above[1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope) - slope
        above = np.concatenate(([0], row))
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``sorted_keys``, whether it is there) of each of ``keys``."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Block:
    """Items as id arrays, their vocabulary, and the seeds: each pair's places in items, and its weight once :meth:`weigh` has run."""

    def __init__(self, ids: list[int], items: list[np.ndarray], vocabulary: dict[str, int]) -> None:
        self.ids, self.items, self.vocabulary = ids, items, vocabulary
        self.base = len(vocabulary) + 1
        owner = np.repeat(np.arange(len(items)), [max(len(x) - 1, min(len(x), 1)) for x in items])
        place = np.concatenate([np.arange(max(len(x) - 1, min(len(x), 1))) for x in items]) if items else owner
        word = lambda at: np.array([items[o][p] if 0 <= p < len(items[o]) else 0 for o, p in zip(owner.tolist(), at.tolist(), strict=True)], np.int64)
        before, first, second, after = (word(place + k) for k in (-1, 0, 1, 2))
        self.pairs, which = np.unique(first * self.base + second, return_inverse=True)  # an item of one word pairs with 0
        order = np.argsort(which, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.starts = np.searchsorted(which[order], np.arange(len(self.pairs) + 1))
        self.before = np.unique((which * self.base + before)[before > 0])
        self.after = np.unique((which * self.base + after)[after > 0])
        self.lone = bool((second == 0).any())
        self.weights, self.least = np.zeros(len(self.pairs)), np.zeros(len(items))

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, an id of 0 after each text; where each text begins, and the end)."""
        known, parts = self.vocabulary, []
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter((known.get(w, 0) for w in [*words, ""]), np.int64, len(words) + 1))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pair) of every pair of the items in ``ids``."""
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        pair, ok = _find(self.pairs, ids[at] * self.base + ids[at + 1])
        at, pair = at[ok], pair[ok]
        if self.lone:
            one = np.flatnonzero(ids > 0)
            own, ok = _find(self.pairs, ids[one] * self.base)
            at, pair = np.concatenate((at, one[ok])), np.concatenate((pair, own[ok]))
        return at, pair

    def strays(self, ids: np.ndarray) -> np.ndarray:
        """How often each pair occurs in ``ids`` without the word that precedes or follows it in an item."""
        at, pair = self.seeds(ids)
        padded = np.concatenate(([0], ids, [0, 0]))
        goes_on = _find(self.before, pair * self.base + padded[at])[1] | _find(self.after, pair * self.base + padded[at + 3])[1]
        return np.bincount(pair[~goes_on], minlength=len(self.pairs))

    def weigh(self, strays: np.ndarray, total: int) -> None:
        """Weights from all documents' stray occurrences and number of words."""
        self.weights = np.maximum(-np.log10((strays + 0.5) / max(total, LEAST_WORDS)), 0.1)
        which = np.repeat(np.arange(len(self.pairs)), np.diff(self.starts))
        count = np.bincount(self.owner, minlength=len(self.items))
        kept = (self.weights[which] >= LEAST_WEIGHT) | (count[self.owner] <= LEAST_SEEDS)
        few = np.bincount(self.owner[kept], minlength=len(self.items)) < LEAST_SEEDS
        kept |= few[self.owner]
        self.least = SHARE * np.bincount(self.owner[kept], self.weights[which[kept]], len(self.items))
        self.owner, self.place = self.owner[kept], self.place[kept]
        self.starts = np.searchsorted(which[kept], np.arange(len(self.pairs) + 1))

    def windows(self, ids: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last diagonal) of the windows to align."""
        at, pair = self.seeds(ids)
        count = self.starts[pair + 1] - self.starts[pair]
        if not count.sum():
            return
        entry = np.repeat(self.starts[pair] - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner, place = self.owner[entry], self.place[entry]
        text = np.repeat(np.searchsorted(cuts, at, "right") - 1, count)
        diagonal, weight = np.repeat(at, count) - place, np.repeat(self.weights[pair], count)
        order = np.lexsort((diagonal, owner, text))
        owner, place, text, diagonal, weight = (x[order] for x in (owner, place, text, diagonal, weight))
        pads = np.array([pad_of(len(x)) for x in self.items])
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(diagonal) > pads[owner[1:]])))
        band = np.cumsum(new) - 1
        once = np.unique(np.stack((band, place)), axis=1, return_index=True)[1]  # a place counts once
        sums = np.bincount(band[once], weight[once])
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(band)])) - 1
        for k in np.flatnonzero(sums >= self.least[owner[first]] - 1e-9).tolist():
            yield int(text[first[k]]), int(owner[first[k]]), int(diagonal[first[k]]), int(diagonal[last[k]])

    def hits(self, texts: list[bytes], threshold: float) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item id, score, first word, words) of each item that it holds a copy of; the best window counts."""
        ids, cuts = self.coded(texts)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        for text, owner, low, high in self.windows(ids, cuts):
            item = self.items[owner]
            length, pad = len(item), pad_of(len(item))
            begin = max(int(cuts[text]), low - pad)
            score, end = align(item, ids[begin:min(int(cuts[text + 1]), high + length + pad)])
            found = (score / (MATCH * length), -(begin - int(cuts[text]) + max(0, end - length + 1)), min(length, end + 1))
            best[text][owner] = max(best[text].get(owner, (0.0, 0, 0)), found)
        return [sorted((self.ids[o], score, -at, n) for o, (score, at, n) in own.items() if score >= threshold) for own in best]


def pad_of(length: int) -> int:
    """How far a window reaches beyond the item, and how far apart the diagonals of its seeds may be."""
    return max(4, length // 2)


def _slices(bodies: list[bytes]) -> Iterator[list[bytes]]:
    """``bodies`` in slices of about _TOGETHER_BYTES, whole texts."""
    held, size = [], 0
    for body in bodies:
        held.append(body)
        size += len(body)
        if size >= _TOGETHER_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_strays(docs: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    """Stray occurrences of each of the block's pairs in all texts, and the number of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        counts, total = np.zeros(len(own.pairs), np.int64), 0
        for batch in batches:
            for part in _slices([x.as_buffer().to_pybytes() for x in batch.column("body")]):
                ids, _ = own.coded(part)
                total += len(ids) - len(part)
                counts += own.strays(ids)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], names=["pair", "n"])

    rows = docs.select(text_bytes().alias("body")).mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most the block's pairs
    strays, total = np.zeros(len(block.pairs), np.int64), 0
    for pair, n in rows:
        if pair < 0:
            total = n
        else:
            strays[pair] = n
    return strays, total


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Block]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(r.text.encode())], np.int64) for r in rows]
        if vocabulary:
            block = Block([r.item_id for r in rows], coded, vocabulary)
            block.weigh(*_count_strays(docs, block))
            yield block


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``row, doc_id, text, hits``: ``row`` holds all columns of ``docs``, ``hits`` the test items in the text, an array of (item_id, score, first_word, words)."""
    hits = F.array().cast(HIT)
    for block in _blocks(docs, benchmark):
        hits = F.concat(hits, _finder(docs, block, threshold)(text_bytes()))
    return packed(docs).withColumn("hits", hits)


def _finder(docs: DataFrame, block: Block, threshold: float) -> Callable[[Column], Column]:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    names = ("item_id", "score", "first_word", "words")

    @F.pandas_udf(HIT)
    def find(bodies: pd.Series) -> pd.Series:
        found = [x for part in _slices(bodies.tolist()) for x in sent.value.hits(part, threshold)]
        return pd.Series([[dict(zip(names, h, strict=True)) for h in x] for x in found], dtype=object)

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, first_word, words``: one row for each document row and test item that it holds a copy of.

    ``score`` is 1 for a perfect copy; ``first_word`` and ``words`` say about
    where. Null and empty texts hold nothing; items that are null or have no
    words are in nothing; items of one word are looked for as that word.
    Repeated rows give repeated rows, an item id that occurs twice counts each
    time; empty tables give an empty result. Only ``doc_id, text`` and
    ``item_id, text`` are read, so other columns may have any name.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark, threshold)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns."""
    return with_hits(docs, benchmark, threshold).where(F.size("hits") == 0).select("row.*")

"""SimHash near-duplicates found by pigeonring filtering.

A text's fingerprint has 64 bits; two texts are linked if at most ``radius``
bits differ. The bits are cut into ``radius + 1`` segments laid on a ring.
Pigeonring principle (strong form): if all differences are at most ``radius``,
then from some segment on, each chain of 1, 2, ... consecutive segments has at
most ``length * radius / segments`` differences. The first link of such a chain
has no difference, so equal segments find the candidates; the longer chains
prune them, and the full Hamming check comes last.

Skew: fingerprints are made distinct first, so exact copies cost one row.
Where many distinct fingerprints share a segment (a large group of near copies),
pairs are not formed: two fingerprints at most 2 bits apart have a midpoint at
most 1 bit from each, so each emits itself and its one-bit neighbours outside
the segment, and those that meet at a midpoint (65 at most) are linked in a
star. The components are the same, and rows grow in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocline.llm.common import join_hot, packed, text_bytes
from pyrocline.operators.components import connected_components
from pyrocline.storage import settle

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: Segment values shared by more distinct fingerprints than this go by midpoints instead of pairs.
PAIR_LIMIT = 64
#: Shingles summed at once; bounds the memory that a very long text takes.
_BLOCK = 1 << 15


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of UTF-8 ``text``: bits set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    count = len(words) - shingle_words + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if count <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:count].tolist(), ends[shingle_words - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, _BLOCK):
        part = np.array([hashed(joined[i:j], SEED) for i, j in zip(first[at:at + _BLOCK], last[at:at + _BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: each row's fingerprint as a signed long. Null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(x.as_buffer().to_pybytes(), shingle_words) for x in batch.column("body")), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each of the ``radius + 1`` segments on the ring."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(first: int, width: int) -> str:
    value = ((1 << width) - 1) << first
    return f"{value - (1 << 64) if value >> 63 else value}L" if value != 1 << 63 else "(-9223372036854775807L - 1L)"


def _ring_keys(distinct: DataFrame, radius: int) -> DataFrame:
    keys = [F.struct(F.lit(k).alias("seg"), F.expr(f"fp & {_mask(*s)}").alias("val")) for k, s in enumerate(segments(radius))]
    return distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.seg", "k.val")


def chain_condition(parts: list[str], radius: int) -> str:
    """SQL for: of the segments' differences ``parts``, in a ring, some chain keeps within its budgets to its full length.

    Budgets are in proportion to a chain's length; the full chain's is ``radius``,
    the Hamming check. True for all fingerprints within ``radius``.
    """
    ring, count = parts + parts, len(parts)
    chains = [" AND ".join(f"{' + '.join(ring[k:k + step])} <= {step * radius // count}" for step in range(1, count + 1)) for k in range(count)]
    return "(" + " OR ".join(f"({x})" for x in chains) + ")"


def _linked(radius: int) -> str:
    """SQL for: x and y, equal in the segment ``seg``, are within ``radius``, by the chain that starts there."""
    parts = [f"bit_count((x.fp ^ y.fp) & {_mask(*s)})" for s in segments(radius)]
    whole = []
    for k in range(len(parts)):
        tests = [f"{' + '.join((parts + parts)[k:k + step])} <= {step * radius // len(parts)}" for step in range(2, len(parts) + 1)]
        whole.append("(" + " AND ".join([f"x.seg = {k}", *tests]) + ")")
    return "(" + " OR ".join(whole) + ")"


def links(distinct: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints ``fp`` to connect all that are within ``radius``.

    Every returned link is at most 2 * (radius // 2 + radius % 2) bits long and
    joins members of the same component; for ``radius`` up to 2, all are true links.
    """
    if radius > 2:
        raise ValueError("midpoints are laid out for a radius of 2 at most")
    if radius == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    keyed = _ring_keys(distinct, radius)
    crowded = keyed.groupBy("seg", "val").count().where(F.col("count") > pair_limit).select("seg", "val")
    crowded = settle(crowded, "crowded")
    sparse = keyed.join(crowded, ["seg", "val"], "left_anti")
    pairs = sparse.alias("x").join(
        sparse.alias("y"), F.expr("x.seg = y.seg AND x.val = y.val AND x.fp < y.fp AND " + _linked(radius))
    ).selectExpr("x.fp AS a", "y.fp AS b")

    flips = [F.array(*[F.expr(f"fp ^ shiftleft(1L, {bit})") for bit in range(BITS) if not s[0] <= bit < s[0] + s[1]]) for s in segments(radius)]
    chosen = flips[-1]
    for k in range(len(flips) - 1):
        chosen = F.when(F.col("seg") == k, flips[k]).otherwise(chosen)
    spread = keyed.join(crowded, ["seg", "val"], "left_semi").repartition("fp")
    if radius == 2:
        near = spread.select("fp", F.explode(F.concat(F.array("fp"), chosen)).alias("mid"))
        met = near.groupBy("mid").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    else:  # radius 1: the other end is itself a one-bit neighbour
        near = spread.select("fp", F.explode(chosen).alias("b"))
        stars = near.join(distinct.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars.select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id``: one row for each row of ``docs``.

    ``component_id`` is the smallest id of all documents reachable by links,
    the document included; null only if every id there is null. Null and empty
    texts have fingerprint 0 and are linked like any other; repeated rows give
    repeated rows; an empty table gives an empty result. Only ``doc_id`` and
    ``text`` are read, so other columns may have any name.
    """
    own = settle(fingerprints(docs, shingle_words), "fingerprints")
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    groups = connected_components(links(distinct.select("fp"), radius, pair_limit))
    members = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component"))
    members = settle(members, "members")
    heads = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = members.join(heads, "component").select("fp", "component_id")
    return join_hot(own, named, "fp", "doc_id").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, of each group of near-duplicates only the one with the smallest id.

    Rows are told apart by id and text; of several texts with the smallest id one
    stays. Rows with a null id stand behind all others.
    """
    keys = ["row_id", "text_hash"]
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    stand_in = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(text_hash, 2) + F.lit(1 << 62))
    keyed = packed(docs).withColumn("row_id", stand_in).withColumn("text_hash", text_hash)
    found = near_duplicates(keyed.select(F.col("text_hash").alias("doc_id"), "text"), radius, shingle_words)
    found = found.select(F.col("doc_id").alias("text_hash"), "component_id").distinct()
    heads = keyed.select(*keys).join(found, "text_hash").groupBy("component_id").agg(F.min(F.struct(*keys)).alias("head")).select("head.*")
    return keyed.join(heads, keys, "left_semi").dropDuplicates(keys).select("row.*")

"""Near copies by SimHash with pigeonring filtering, at a similarity: five-word shingle sets with a Jaccard similarity of at least 0.8.

The near-duplicate operator's 64-bit fingerprints link texts that differ by up to 2
bits; sets at a similarity of 0.8 differ by 15 % of the bits of any SimHash, and no
segment of a fingerprint with so many differences can be looked up. So at a
similarity candidates come from min-hashes, are pruned by pigeonring chains over wide
fingerprints and the full Hamming check, and are checked exactly:

1. Equal sets are made one, so exact copies cost one row. Each set has ``BANDS``
   keys of ``ROWS`` min-hashes and as many finer ones of two bands each. Two sets at a
   similarity of just 0.8 share no key with probability 1.2e-7, closer ones with less.
2. Of the sets behind a key, each is compared with the smallest and with the one that
   meets most others behind all its keys, the likeliest middle of a group. Pairs whose
   fingerprints of ``64 * WORDS`` bits break the chains' budgets go; the exact
   similarity decides, and the links found make components.
3. Sets behind keys whose sets are in different components by then are joined
   across components on their rarest shingles, of which any two similar sets share
   one. How many shingles two sets can have in common is bounded by ``CELLS`` counts
   of each (shingles that other sets have too, by hash): the sum of the lesser ones.
   The bound is a condition of the join, so hardly a pair leaves it that isn't
   similar. Chains and the exact similarity decide again.

The fingerprints of sets at 0.8 differ by 155 bits of 1,024 with a deviation of 11.5
(simulated for 9 to 900 shingles: 140 to 158, 9 to 12); ``RADIUS`` 200 loses about one
such pair in 15,000. Sets of under ``FEW`` shingles aren't filtered.

Skew: a large group of near copies is nearly one component after step 2 and costs
a row for each set and key, not for each pair. What remains quadratic, in comparisons
within the join and not in rows: many sets of step 3 that share a rare shingle and
aren't similar to one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrocline.llm.common import give_back, packed, small_enough, text_bytes
from pyrocline.llm.simhash import chain_condition
from pyrocline.operators.components import connected_components
from pyrocline.storage import settle

SHINGLE_WORDS = 5
#: Least similarity, as a fraction in whole numbers.
LEAST, OF = 4, 5
BANDS, ROWS = 40, 5
#: Words of a fingerprint, segments (of whole words) that it is cut into, bits that similar sets may differ by, least shingles for the filter.
WORDS, SEGMENTS, RADIUS, FEW = 16, 4, 200, 16
#: Counts by which the shingles that two sets can share are bounded.
CELLS = 32
SEED = 42
#: Shingles min-hashed at once; bounds the memory that a very long text takes.
_BLOCK = 1 << 10
#: Texts whose shingles are held at once.
_ROWS_AT_ONCE = 500
_DRAW = np.random.default_rng(SEED)
_FLIP = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 64, WORDS, dtype=np.uint64)


def shingles_of(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 ``text``; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    last = ends[min(len(words), SHINGLE_WORDS) - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[i:j], SEED) for i, j in zip(starts, last, strict=True)), np.uint64, count))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set that isn't empty, then as many of a band and the next one."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(least, ((shingles[at:at + _BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    bands = [band.tobytes() for band in least.reshape(BANDS, ROWS)]
    wide = [a + b for a, b in zip(bands, [*bands[1:], bands[0]], strict=True)]
    return np.array([xxhash.xxh64_intdigest(x, n) for n, x in enumerate(bands + wide)], np.uint64).view(np.int64)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` words of bits set in over half of the hashes of a set, each word by hashes of its own (the hash, shifted and mixed)."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), _BLOCK):
        mixed = shingles[at:at + _BLOCK, None] + _SHIFT
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(times)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` cut to ``_ROWS_AT_ONCE`` rows, so that shingles of few texts are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(at, _ROWS_AT_ONCE)
    give_back()


def _signatures(rows: DataFrame) -> DataFrame:
    """``row_id, text_hash, set_id, keys`` of ``rows`` (row_id, text_hash, body); without words set 0 and no keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, keys = [], []
            for body in batch.column("body"):
                found = shingles_of(body.as_buffer().to_pybytes())
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
                keys.append(band_keys(found) if len(found) else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column("row_id"), batch.column("text_hash"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                                  names=["row_id", "text_hash", "set_id", "keys"])

    return rows.mapInArrow(each, "row_id long, text_hash long, set_id long, keys array<long>")


_PRINT = [f"w{k}" for k in range(WORDS)]
_COUNTS = [f"c{k}" for k in range(CELLS)]


def _sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``set_id, shingles, n`` and the fingerprint's words of the sets in ``needed`` (set_id, text_hash), read from ``rows`` again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles_of(body.as_buffer().to_pybytes()) for body in batch.column("body")]
            prints = np.array([fingerprint(x) for x in found], np.int64).reshape(len(found), WORDS)
            columns = [batch.column("set_id"), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([len(x) for x in found], pa.int32())]
            yield pa.record_batch([*columns, *[pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WORDS)]], names=["set_id", "shingles", "n", *_PRINT])

    needed = F.broadcast(needed) if small_enough(needed) else needed
    kinds = "set_id long, shingles array<long>, n int, " + ", ".join(f"{w} long" for w in _PRINT)
    return rows.join(needed, "text_hash").select("set_id", "body").mapInArrow(each, kinds).dropDuplicates(["set_id"])


def _may_be_similar(x: str, y: str) -> str:
    """SQL for: the sizes allow it, and the fingerprints' chains keep within their budgets."""
    cuts = [WORDS * k // SEGMENTS for k in range(SEGMENTS + 1)]
    parts = [" + ".join(f"bit_count({x}.w{w} ^ {y}.w{w})" for w in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return f"{OF} * least({x}.n, {y}.n) >= {LEAST} * greatest({x}.n, {y}.n) AND (least({x}.n, {y}.n) < {FEW} OR {chain_condition(parts, RADIUS)})"


def _prefixes(sets: DataFrame) -> DataFrame:
    """``set_id, shingle, n`` and counts: each set's rarest shingles, as many as it takes for any two similar sets to share one (Chaudhuri et al. 2006).

    The counts are of the set's shingles that other sets have too, by hash; sets
    of which less than LEAST / OF of all ``n`` are such can't be similar and go.
    """
    listed = sets.select("set_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = listed.groupBy("shingle").agg(F.count("*").alias("often"))
    nth = F.row_number().over(Window.partitionBy("set_id").orderBy("often", "shingle"))
    ranked = settle(listed.join(often, "shingle").withColumn("nth", nth), "ranked")
    counts = ranked.where("often > 1").groupBy("set_id").agg(F.count("*").alias("common"), F.first("n").alias("n"), *[F.count_if(F.expr(f"pmod(shingle, {CELLS}) = {k}")).cast("int").alias(c) for k, c in enumerate(_COUNTS)])
    counts = settle(counts, "counts").where(f"{OF} * common >= {LEAST} * n").select("set_id", *_COUNTS)
    first = ranked.where(f"nth <= n - ({LEAST} * n + {OF - 1}) div {OF} + 1 AND often > 1").select("set_id", "shingle", "n")
    return first.join(counts, "set_id")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose fingerprints keep within the chains' budgets and whose similarity is at least LEAST / OF."""
    prints = sets.select("set_id", "n", *_PRINT)
    near = pairs.join(prints.alias("x"), F.expr("a = x.set_id")).join(prints.alias("y"), F.expr(f"b = y.set_id AND {_may_be_similar('x', 'y')}")).select("a", "b")
    near = settle(near, "near")
    both = near.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.expr("size(x) + size(y)").alias("sizes"))
    return both.where(f"{OF} * shared >= {LEAST} * (sizes - shared)").select("a", "b")


def _links(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """``a, b``: enough links between similar sets to connect all that are linked by any."""
    keyed = distinct.select("set_id", F.posexplode("keys").alias("at", "key")).repartition("key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = settle(keyed.join(sizes, "key"), "shared")
    # How many others a set meets behind all its keys: the one that meets most is likeliest to be similar to many.
    met = settle(shared.groupBy("set_id").agg(F.sum("sets").alias("met")), "met")
    ranked = shared.select("key", "set_id").join(met, "set_id")
    heads = ranked.groupBy("key").agg(F.max_by("set_id", F.struct("met", "set_id")).alias("most"), F.min("set_id").alias("least"))
    spokes = shared.select("key", "set_id").join(heads, "key").select("set_id", F.explode(F.array_distinct(F.array("most", "least"))).alias("head")).where("head <> set_id")
    stars = settle(spokes.select(F.least("head", "set_id").alias("a"), F.greatest("head", "set_id").alias("b")).distinct(), "stars")
    needed = settle(distinct.select("set_id", "text_hash").join(met, "set_id", "left_semi"), "needed")
    sets = settle(_sets(rows, needed), "sets")
    first = settle(_similar(stars, sets), "first")

    groups = connected_components(first).withColumnRenamed("node", "set_id")
    now = settle(shared.where(f"at < {BANDS}").select("key", "set_id").join(groups, "set_id", "left").select("key", "set_id", F.coalesce("component", "set_id").alias("component")), "grouped")
    mixed = now.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    undecided = settle(now.join(mixed, "key", "left_semi").select("set_id", "component").distinct(), "undecided")
    listed = _prefixes(sets.join(undecided, "set_id", "left_semi").select("set_id", "shingles")).join(undecided, "set_id")
    listed = settle(listed, "prefixes")
    # With I shingles in common the similarity is I / (n + m - I).
    bound = " + ".join(f"least(x.{c}, y.{c})" for c in _COUNTS)
    sizes = f"{OF} * least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n)"
    apart = listed.alias("x").join(listed.alias("y"), F.expr(f"x.shingle = y.shingle AND x.component < y.component AND {sizes} AND {LEAST + OF} * ({bound}) >= {LEAST} * (x.n + y.n)"))
    pairs = apart.select(F.expr("least(x.set_id, y.set_id)").alias("a"), F.expr("greatest(x.set_id, y.set_id)").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    return first.unionByName(_similar(settle(pairs, "apart"), sets))


def near_copies(rows: DataFrame) -> DataFrame:
    """``row_id, text_hash, head``: for each of ``rows`` (row_id, text_hash, body) the smallest (row_id, text_hash) of all reachable by links."""
    own = settle(_signatures(rows.select("row_id", "text_hash", "body")), "signatures")
    least = F.min(F.struct("row_id", "text_hash")).alias("least")
    distinct = settle(own.groupBy("set_id").agg(least, F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys")), "distinct")
    groups = connected_components(_links(rows, distinct)).withColumnRenamed("node", "set_id")
    members = distinct.select("set_id", "least").join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    members = settle(members, "members")
    heads = members.groupBy("component").agg(F.min("least").alias("head"))
    named = members.join(heads, "component").select("set_id", "head")
    return own.select("row_id", "text_hash", "set_id").join(named, "set_id").select("row_id", "text_hash", "head")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, of each group of near copies only the one with the smallest id.

    Rows are told apart by id and text; of several texts with the smallest id one
    stays. Rows with a null id stand behind all others. Texts without words are
    copies of one another. Only ``doc_id`` and ``text`` are read otherwise.
    """
    text_hash = F.xxhash64(text_bytes())
    stand_in = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(text_hash, 2) + F.lit(1 << 62))
    keyed = packed(docs).withColumn("row_id", stand_in).withColumn("text_hash", text_hash)
    found = near_copies(keyed.select("row_id", "text_hash", text_bytes().alias("body")))
    extra = found.where("row_id <> head.row_id OR text_hash <> head.text_hash").select("row_id", "text_hash").distinct()
    keys = ["row_id", "text_hash"]
    return keyed.join(extra, keys, "left_anti").dropDuplicates(keys).select("row.*")

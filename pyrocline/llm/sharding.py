"""Sharding by sampled splitters, in DataFrame operations only; the law kept is ``bytes``.

1. Sample: a record is drawn with a probability in proportion to its size (by a
   seeded hash, so reruns agree).
2. Splitters: quantiles of the sampled keys by weight. The key is the text's
   hash, so equal texts lie side by side and sit in one shard where they fit.
3. Range-partition: every record finds its range between the splitters.
4. Overfull ranges are subdivided: records larger than a range is meant to be come to
   lie alone, the others (a text with very many copies has one key) are cut up by a
   hash of the id.
5. Exact sums of the pieces place them. Those of a single large record (fewer than
   the ranges) go largest to emptiest, and the shards' remaining room is what the
   others fill, one after the other; a record's shard follows from its position in
   bytes. So shards differ by about a range at most, unless one record alone exceeds
   a shard.

The number of ranges grows with the bytes (``RANGE_BYTES``), so no task orders
more than one piece. The driver sees one size for each large record.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrocline.llm.common import small_enough
from pyrocline.storage import settle

SHARDS = 24
RANGES_PER_SHARD = 64
RANGE_BYTES = 256 << 20
SAMPLES_PER_RANGE = 8
#: Added to each text's bytes for its size.
ROW_BYTES = 8
SEED = 42


def _records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
                       F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64(text)).alias("draw"))


def splitters(records: DataFrame, ranges: int, total: int) -> DataFrame:
    """``key``: up to ``ranges - 1`` keys that cut ``records`` (key, size, draw) into ranges of about equal bytes."""
    rate = F.least(F.lit(1.0), F.col("size") * (ranges * SAMPLES_PER_RANGE) / F.lit(float(total)))
    chance = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    sample = records.withColumn("rate", rate).where(chance < F.col("rate")).select("key", (F.col("size") / F.col("rate")).alias("weight"))
    order = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("weight").over(order), F.lit(0.0)) / F.sum("weight").over(Window.partitionBy())
    part = F.floor(share * ranges)
    return sample.select("key", part.alias("part")).groupBy("part").agg(F.min("key").alias("key")).where("part > 0").select("key").distinct()


def find_range(records: DataFrame, cuts: DataFrame, ranges: int) -> DataFrame:
    """Add ``part``: how many of ``cuts`` are at most the record's key.

    Cuts are listed by the key's leading bits, so a record compares itself with
    the few of its own cell; no join compares all records with all cuts.
    """
    bits = max(12, (ranges - 1).bit_length())
    cell = F.shiftright("key", 64 - bits)
    own = cuts.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list("key")).alias("own"))
    half = 1 << (bits - 1)
    cells = records.sparkSession.range(-half, half).select(F.col("id").alias("cell")).join(own, "cell", "left")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce("own", F.array().cast("array<bigint>")).alias("own"),
                         F.coalesce(F.sum(F.coalesce(F.size("own"), F.lit(0))).over(before), F.lit(0)).alias("base"))
    cells = settle(cells, "cells")
    cells = F.broadcast(cells) if small_enough(cells) else cells
    return records.withColumn("cell", cell).join(cells, "cell").withColumn(
        "part", F.col("base") + F.expr("size(filter(own, x -> x <= key))")).drop("cell", "own", "base")


def deal(sizes: list[int], shards: int, small_bytes: int) -> tuple[list[int], list[int]]:
    """(shard of each of the large ``sizes``, given largest first; cuts in bytes of all others).

    Each size goes to the emptiest shard. The others fill all shards to one level.
    """
    heap = [(0, k) for k in range(shards)]
    where, load = [], [0] * shards
    for size in sizes:
        _, k = heapq.heappop(heap)
        load[k] += size
        where.append(k)
        heapq.heappush(heap, (load[k], k))
    level, ordered = 0.0, sorted(load)
    for n in range(1, shards + 1):
        level = (small_bytes + sum(ordered[:n])) / n
        if n == shards or level <= ordered[n]:
            break
    cuts, at = [], 0.0
    for k in range(shards):
        at += max(0.0, level - load[k])
        cuts.append(round(at))
    return where, cuts


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs``.

    A null text counts as empty; null ids are kept; repeated rows are separate
    records; slots count from 0 in each shard without gaps; with fewer rows than
    shards some shards stay empty; an empty table gives an empty result. Only
    ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    records = settle(_records(docs), "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = ranges or max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    found = settle(find_range(records, splitters(records, ranges, max(total, 1)), ranges), "found")

    # Overfull ranges are subdivided.
    full = F.lit(max(total, 1) / ranges)
    sums = found.groupBy("part").agg(F.sum("size").alias("bytes"), F.sum(F.when(F.col("size") <= full, F.col("size")).otherwise(0)).alias("rest"))
    overfull = sums.where(F.col("bytes") > full).select("part", F.greatest(F.ceil(F.col("rest") / full), F.lit(1)).cast("long").alias("slices"))
    overfull = settle(overfull, "overfull")
    overfull = F.broadcast(overfull) if small_enough(overfull) else overfull
    cut_up = F.coalesce(F.pmod(F.col("draw"), F.col("slices")), F.lit(0))
    kept = ["doc_id", "size", "text_crc32", "key", "draw", "part"]
    ranged = found.join(overfull, "part", "left").select(*kept, cut_up.alias("slice"), (F.col("slices").isNotNull() & (F.col("size") > full)).alias("alone"))
    ranged = settle(ranged, "ranged")
    small = ranged.where("NOT alone").drop("alone")

    # Ranges lie one after the other.
    line = Window.orderBy("part", "slice")
    units = small.groupBy("part", "slice").agg(F.sum("size").alias("bytes"))
    units = units.select("part", "slice", (F.sum("bytes").over(line) - F.col("bytes")).alias("offset"), F.col("bytes"))
    units = settle(units, "units")
    small_bytes = units.agg(F.sum("bytes")).first()[0] or 0
    by_size = Window.orderBy(F.col("size").desc(), "key", "draw", "doc_id")
    large = settle(ranged.where("alone").select(*kept).withColumn("nth", F.row_number().over(by_size) - 1), "large")
    sizes = [r[0] for r in large.orderBy("nth").select("size").collect()]
    where, cuts = deal(sizes, shards, small_bytes)

    inside = Window.partitionBy("part", "slice").orderBy("key", "draw", "doc_id")
    lookup = units.select("part", "slice", "offset")
    lookup = F.broadcast(lookup) if small_enough(lookup) else lookup
    placed = small.join(lookup, ["part", "slice"]).withColumn("middle", F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    placed = placed.withColumn("shard", F.size(F.filter(F.lit(cuts[:-1]).cast("array<bigint>"), lambda c: c <= F.col("middle"))) if shards > 1 else F.lit(0))
    nth = F.row_number().over(Window.partitionBy("part", "slice", "shard").orderBy("key", "draw", "doc_id")) - 1
    placed = settle(placed.select("doc_id", "size", "text_crc32", "shard", "part", "slice", nth.alias("nth")), "placed")

    # Slots go on from range to range within a shard; the large records come last.
    runs = placed.groupBy("shard", "part", "slice").agg(F.count("*").alias("rows"))
    along = Window.partitionBy("shard").orderBy("part", "slice")
    runs = settle(runs.select("shard", "part", "slice", (F.sum("rows").over(along) - F.col("rows")).alias("first"), "rows"), "runs")
    lookup = F.broadcast(runs) if small_enough(runs) else runs
    small_out = placed.join(lookup, ["shard", "part", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"))
    listed = json.dumps([{"nth": i, "shard": k} for i, k in enumerate(where)])
    chosen = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<nth:int,shard:int>>")).alias("x")).select("x.nth", "x.shard")
    full = runs.groupBy("shard").agg(F.sum("rows").alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("nth")) - 1
    large_out = large.join(F.broadcast(chosen), "nth").withColumn("rank", rank).join(full, "shard", "left").select(
        "doc_id", "size", "text_crc32", "shard", (F.coalesce("first", F.lit(0)) + F.col("rank")).alias("slot"))
    return small_out.unionByName(large_out)

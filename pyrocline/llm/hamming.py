"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; an index holds each segment's values. A search
probes all values at segment radius 0, then 1, 2, ...: after radius r, every
code within ``segments * (r + 1) - 1`` bits has been seen (pigeonhole). The
search of a query ends when its k-th verified distance is covered by that bound.

Equal codes are indexed once. The index is dealt into blocks of bounded size by
a hash of the code, and queries into blocks as well; each pair of blocks is
searched on its own, so memory is bounded by the block sizes, and what leaves a
block is k codes for each query. A code that very many rows share answers with
its k smallest ids, which is all that a top-k needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrocline.storage import settle

#: Distinct codes in one index block, queries in one query block.
BLOCK_CODES = 1 << 16
BLOCK_QUERIES = 1 << 12
QUERY_EVERY = 100
K = 10


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, code``: one bit for each component, set where it is above zero, as bytes.

    Rows with a null id or vector are left out: they have no code.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            if not batch.num_rows:
                continue
            flat = vecs.flatten().to_numpy(zero_copy_only=False) > 0  # nulls become NaN, which isn't above zero
            at = np.concatenate(([0], np.cumsum(vecs.value_lengths().to_numpy())))
            codes = [np.packbits(flat[a:b], bitorder="little").tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.record_batch([batch.column("id"), pa.array(codes, pa.binary())], names=["id", "code"])

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).mapInArrow(each, "id long, code binary")


@cache
def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


class SegmentIndex:
    """Multi-index over the rows of ``codes`` (n x bytes), each segment with about log2(n) bits."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, bits = codes, codes.shape[1] * 8
        width = min(16, max(4, int(np.log2(max(len(codes), 2)))))
        count = max(1, round(bits / width))
        self.cuts = [bits * k // count for k in range(count + 1)]
        self.orders, self.starts = [], []
        for k in range(count):
            values = self.segment(codes, k)
            self.orders.append(np.argsort(values, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << self.width(k))))))

    def width(self, k: int) -> int:
        return self.cuts[k + 1] - self.cuts[k]

    def segment(self, codes: np.ndarray, k: int) -> np.ndarray:
        bits = np.unpackbits(codes, axis=1, bitorder="little")[:, self.cuts[k]:self.cuts[k + 1]]
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1], dtype=np.int64))

    def search(self, query: np.ndarray, weights: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes up to the distance at which the rows behind them (``weights``) reach ``need``."""
        total = len(self.cuts) - 1
        own = [int(self.segment(query[None], k)[0]) for k in range(total)]
        seen = np.zeros(len(self.codes), bool)
        at, far = [], []
        for radius in range(max(self.width(k) for k in range(total)) + 1):
            found = []
            for k in range(total):
                if radius <= self.width(k):
                    values = own[k] ^ _masks(self.width(k), radius)
                    for a, b in zip(self.starts[k][values].tolist(), self.starts[k][values + 1].tolist(), strict=True):
                        if a < b:
                            found.append(self.orders[k][a:b])
            if found:
                new = np.unique(np.concatenate(found))
                new = new[~seen[new]]
                seen[new] = True
                at.append(new)
                far.append(np.bitwise_count(self.codes[new] ^ query).sum(axis=1, dtype=np.int64))
            covered = total * (radius + 1) - 1
            if far:
                where, distance = np.concatenate(at), np.concatenate(far)
                near = distance <= covered
                if weights[where[near]].sum() >= need:
                    order = np.argsort(distance[near], kind="stable")
                    reach = np.cumsum(weights[where[near]][order])
                    kth = distance[near][order][np.searchsorted(reach, need)]
                    keep = distance <= kth
                    return where[keep], distance[keep]
        return (np.concatenate(at), np.concatenate(far)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, id, distance``: for each of ``queries`` its ``k`` nearest rows of ``codes`` (both id, code).

    The query's own id is left out. Ties go to the smaller id; ranks count from
    1; fewer than k rows are returned only if there are no more. Codes must have
    one length (a row of another length raises). Repeated rows are separate rows
    with one id; nulls are left out; empty tables give an empty result.
    """
    codes = codes.where("id IS NOT NULL AND code IS NOT NULL")
    # k + 1 ids for each code, taken first within salted parts so that a very common code is no hot group.
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    first = salted.withColumn("nth", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("nth") <= k + 1)
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nth") <= k + 1)
    index = settle(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    blocks = max(1, -(-index.count() // BLOCK_CODES))
    asked = settle(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code"), "queries")
    asked_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    # Enough query blocks to keep the cluster busy when the index is small.
    spread = max(asked_blocks, min(32, 64 // blocks))
    packed = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")).select(F.lit(1).cast("int").alias("side"), "q", "id", "code", F.array().cast("array<bigint>").alias("ids"))
    packed = packed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    stored = index.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).select(F.lit(0).cast("int").alias("side"), F.lit(-1).cast("long").alias("id"), "code", "ids", "b")
    stored = stored.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        here, there = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out: list[tuple[int, int, int]] = []
        if here.num_rows and there.num_rows:
            raw, ids = here.column("code").to_pylist(), here.column("ids").to_pylist()
            if len({*map(len, raw), *map(len, there.column("code").to_pylist())}) != 1:
                raise ValueError("codes differ in length")
            matrix = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            index, weights = SegmentIndex(matrix), np.array([len(x) for x in ids], np.int64)
            for qid, code in zip(there.column("id").to_pylist(), there.column("code").to_pylist(), strict=True):
                where, distance = index.search(np.frombuffer(code, np.uint8), weights, k + 1)
                best = sorted((d, i) for p, d in zip(where.tolist(), distance.tolist(), strict=True) for i in ids[p] if i != qid)[:k]
                out += [(qid, i, d) for d, i in best]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "distance"), columns, strict=True)})

    found = stored.select("side", "q", "b", "id", "code", "ids").unionByName(packed).groupBy("q", "b").applyInArrow(search, "query_id long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

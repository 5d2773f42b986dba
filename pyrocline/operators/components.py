"""Connected components of an undirected graph by alternating stars.

Published method: Kiveris et al. 2014, "Connected Components in MapReduce and
Beyond". Every round rewires edges towards smaller neighbours; the graph ends as
stars whose centres are the smallest node of each component. The number of
edges never grows, and rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocline.storage import settle

#: Far above the logarithmic number of rounds; reaching it means a defect.
MAX_ROUNDS = 200
#: Up to this many edges are solved by one task, which takes less than a round.
FEW_EDGES = 250_000


def _star(edges: DataFrame, ends: Column, outward: Column) -> DataFrame:
    """Link what ``outward`` selects around each node to the node's smallest neighbour or itself."""
    around = edges.select(F.explode(ends).alias("e")).select("e.node", "e.other")
    least = around.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return around.join(least.hint("merge"), "node").select(
        F.explode(outward).alias("e")
    ).select(F.col("e.hi").alias("hi"), F.col("e.lo").alias("lo")).where("hi <> lo").distinct()


def _pair(first: str, second: str, names: tuple[str, str]) -> Column:
    return F.struct(F.col(first).alias(names[0]), F.col(second).alias(names[1]))


def _solve(table: pa.Table) -> pa.Table:
    """Components of one table of edges, by union-find with the smaller root on top."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[up]
        return node

    for hi, lo in zip(table.column("hi").to_pylist(), table.column("lo").to_pylist(), strict=True):
        a, b = root(hi), root(lo)
        parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([root(n) for n in nodes], pa.int64())})


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", few_edges: int = FEW_EDGES) -> DataFrame:
    """``node, component`` for each node that has an edge; component is its smallest reachable node.

    Edges with a null end and loops are ignored; repeated edges count once; an
    empty input gives an empty result. Nodes that have no edge don't appear.
    Other columns of ``edges`` are not read. Nodes are longs.
    """
    both = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"),
                        (F.col(left).isNotNull() & F.col(right).isNotNull()).alias("ok"))
    now = settle(both.where("ok and hi <> lo").select("hi", "lo").distinct(), "edges")
    if now.limit(few_edges + 1).count() <= few_edges:
        return now.withColumn("all", F.lit("edges")).groupBy("all").applyInArrow(_solve, "node long, component long")
    seen = None
    for _ in range(MAX_ROUNDS):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
        if not seen[0]:
            break
        both_ways = F.array(_pair("hi", "lo", ("node", "other")), _pair("lo", "hi", ("node", "other")))
        down_only = F.array(_pair("hi", "lo", ("node", "other")))
        above = F.when(F.col("other") > F.col("node"), F.array(_pair("other", "least", ("hi", "lo"))))
        below = F.array(_pair("other", "least", ("hi", "lo")), _pair("node", "least", ("hi", "lo")))
        now = settle(_star(_star(now, both_ways, above), down_only, below), "stars")
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        centres.select("node", F.col("node").alias("component")))

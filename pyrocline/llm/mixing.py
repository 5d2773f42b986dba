"""Mixing sources to target weights by capped water-filling.

Weights share a budget of words among sources. A source stops at ``max_epochs``
times its own size; what it cannot take is shared again by weight among the
rest until no target is above its limit. That fixed point has a closed form:
sort sources by limit / weight; those below the water level take their limit,
the others level * weight.

Repetitions: with ratio target / size, each document is taken floor(ratio) times
whole, and a seeded part of the documents once more: those that come first in the
order of a seeded hash, up to the remaining words. The hash knows nothing of sizes, so
long and short documents are equally likely to be taken once more. The document at the
cut is taken if its middle lies before it; what that leaves over or under is evened
out by documents that fit into the difference, ``PASSES`` times in the same order
(taken if words are missing, left out if there are too many).

Skew: the order within a source is never sorted as a whole. Words are summed by
source and hash cell; only rows of the one cell that the cut falls into are
ordered, so a source with a third of all rows is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrocline.llm.common import packed, small_enough
from pyrocline.storage import settle

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 42
#: Rounds that even out what the cut leaves.
PASSES = 3
#: Leading bits of the hash that tell a source's cells apart.
CELL_BITS = 12


def word_count(column: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``sources`` (source, source_size long, weight double > 0).

    The budget is the sum of all sizes. One row for each source, so the table is
    as small as the number of sources; the sums run over that table alone.
    """
    every = Window.partitionBy()
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = sources.withColumn("limit", max_epochs * F.col("source_size")).withColumn("level", F.col("limit") / F.col("weight"))
    steps = steps.withColumn("budget", F.sum("source_size").over(every).cast("double"))
    water = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    steps = steps.withColumn("water", water)
    reached = F.max(F.when(F.col("water") < F.col("level"), F.col("water"))).over(every)
    target = F.least("limit", F.coalesce(reached, F.lit(float("inf"))) * F.col("weight"))
    return steps.withColumn("target", target).drop("limit", "level", "budget", "water")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` of ``sizes`` (source, size); weights repeat over sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return water_fill(totals.withColumn("weight", weight), max_epochs).select("source", "source_size", "target")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, text_hash, size, source_size, target, copies``: how often the mix takes each row.

    ``size`` is the number of words; null and empty texts have size 0 and are
    taken as often as the ratio's whole part says. A null source is a source of
    its own. Rows that share id, text and source are drawn together, so which
    of them the cut leaves out makes no difference to the result. An empty
    table gives an empty result. Only ``doc_id, text, source`` are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), word_count().alias("size"))
    rows = settle(rows, "sizes")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(rows, weights, max_epochs).withColumn("whole", F.floor(ratio).cast("long"))
    goal = settle(goal.withColumn("spare", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    drawn = rows.alias("r").join(_lookup(goal).alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")), "left").select(
        "r.*", "g.source_size", "g.target", "g.whole", F.xxhash64(F.lit(seed), "r.doc_id", "r.text_hash").alias("draw"), F.lit(0).alias("once"))
    left = goal.select("source", F.col("spare").alias("gap"))
    for n in range(PASSES + 1):
        drawn = settle(_even_out(drawn, left, middle=not n), "drawn")
        taken = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("once")).alias("taken"))
        left = goal.alias("g").join(taken.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.source", (F.col("g.spare") - F.col("t.taken")).alias("gap"))
    return drawn.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("whole") + F.col("once")).alias("copies"))


def _even_out(drawn: DataFrame, left: DataFrame, middle: bool) -> DataFrame:
    """``drawn`` with ``once`` turned over for the first documents by their draw that fill ``left`` (source, gap: words missing, or too many below 0).

    Only documents that fit into the gap are turned over; ``middle``: any, and the
    one at the cut if its middle lies before it.
    """
    kept = drawn.columns
    found = drawn.alias("s").join(_lookup(settle(left, "left")).alias("l"), F.col("s.source").eqNullSafe(F.col("l.source"))).select("s.*", "l.gap")
    fits = (F.col("size") > 0) & (F.col("once") == (F.col("gap") < 0).cast("int"))
    fits = fits if middle else fits & (F.col("size") <= F.abs("gap"))
    found = found.withColumns({"fits": fits, "at": F.when(F.col("gap") < 0, F.bitwise_not("draw")).otherwise(F.col("draw"))})
    found = found.withColumn("cell", F.shiftright("at", 64 - CELL_BITS))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = found.where("fits").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    cells = cells.withColumn("room", F.abs("gap") - F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    state = F.when(F.col("words") <= F.col("room"), "all").otherwise("cut")
    cells = settle(cells.where("room > 0").select("source", "cell", "room", state.alias("state")), "cells")
    same_cell = F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.cell") == F.col("c.cell"))
    found = found.alias("s").join(_lookup(cells).alias("c"), same_cell, "left").select("s.*", "c.room", "c.state")
    cut = (F.col("state") == "cut") & F.col("fits")
    turned = F.col("once").bitwiseXOR((F.col("fits") & (F.col("state") == "all")).cast("int"))
    rest = found.where(~F.coalesce(cut, F.lit(False))).withColumn("once", F.coalesce(turned, F.col("once")))
    order = Window.partitionBy("source").orderBy("at", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum("size").over(order) - (F.col("size") / 2 if middle else F.lit(0)) <= F.col("room")
    ends = found.where(cut).withColumn("once", F.col("once").bitwiseXOR(inside.cast("int")))
    return rest.unionByName(ends).select(*kept)


def _lookup(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df) else df


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows taken no times go.

    Rows that share id, text and source are taken equally often, the rounded mean.
    """
    plan = plan_mix(docs, weights, max_epochs, seed).groupBy("doc_id", "text_hash", "source").agg(F.round(F.avg("copies")).cast("int").alias("copies"))
    keyed = packed(docs, "doc_id", "source").withColumn("text_hash", F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))))
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")) & F.col("d.source").eqNullSafe(F.col("p.source"))
    joined = keyed.alias("d").join(plan.where("copies > 0").alias("p"), same)
    return joined.select("d.row", F.explode(F.sequence(F.lit(1), F.col("p.copies"))).alias("nth")).select("row.*")

"""Merging blocks: what a merge costs, the best of each block, and carrying the best out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import join_gain, race, uniform, xlogx
from sparkloom.operators.blocks.state import degrees
from sparkloom.operators.matrix import dense_ids
from sparkloom.plans.shared import cut


def adjacent_pairs(m: DataFrame) -> DataFrame:
    """``r < s`` of all blocks with an edge between them."""
    return m.where("r <> c").select(F.least("r", "c").alias("r"), F.greatest("r", "c").alias("s")).distinct()


def delta_entropy(m: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``r, s, delta``: how the data entropy grows when two blocks merge. Only rows and columns that both have matter.

    The candidates carry the lookups, so a block that everything is joined with is not squared.
    """
    pairs = adjacent_pairs(m) if pairs is None else pairs
    gains = []
    for own, other in (("r", "c"), ("c", "r")):
        first = m.select(F.col(own).alias("r"), F.col(other).alias("t"), F.col("m").alias("m1"))
        second = m.select(F.col(own).alias("s"), F.col(other).alias("t"), F.col("m").alias("m2"))
        both = pairs.join(first, "r").where("t <> r and t <> s").join(second, ["s", "t"])
        gains.append(both.select("r", "s", (-join_gain(F.col("m1"), F.col("m2"))).alias("delta")))
    cells = pairs.select("r", "s", F.explode(F.array(F.struct(F.col("r").alias("x"), F.col("r").alias("y")), F.struct(F.col("r").alias("x"), F.col("s").alias("y")), F.struct(F.col("s").alias("x"), F.col("r").alias("y")), F.struct(F.col("s").alias("x"), F.col("s").alias("y")))).alias("cell"))
    corner = cells.join(m.select(F.struct(F.col("r").alias("x"), F.col("c").alias("y")).alias("cell"), "m"), "cell")
    gains.append(corner.groupBy("r", "s").agg(F.sum("m").alias("whole"), F.sum(xlogx(F.col("m"))).alias("parts")).select("r", "s", (F.col("parts") - xlogx(F.col("whole"))).alias("delta")))
    d = degrees(m)
    ends = pairs.join(d.select(F.col("block").alias("r"), F.col("d_out").alias("o1"), F.col("d_in").alias("i1")), "r").join(d.select(F.col("block").alias("s"), F.col("d_out").alias("o2"), F.col("d_in").alias("i2")), "s")
    gains.append(ends.select("r", "s", (join_gain(F.col("o1"), F.col("o2")) + join_gain(F.col("i1"), F.col("i2"))).alias("delta")))
    whole = gains[0]
    for g in gains[1:]:
        whole = whole.unionByName(g)
    return whole.groupBy("r", "s").agg(F.sum("delta").alias("delta"))


def sampled_pairs(m: DataFrame, proposals: int, seed: int, blocks: int) -> DataFrame:
    """``proposals`` candidates a block, drawn as in a node move, as pairs ``r < s``; blocks are named 0 to ``blocks - 1``.

    A neighbour u is drawn by weight; then, with probability B / (d(u) + B), any other block, else one that u has edges with.
    """
    d = degrees(m)
    cells = m.unionByName(m.select(F.col("c").alias("r"), F.col("r").alias("c"), "m")).groupBy("r", "c").agg(F.sum("m").alias("m")).where("r <> c")
    draws = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(proposals))).alias("draw"))
    first = draws.groupBy("r", "draw").agg(F.min_by("c", F.struct(race(F.col("m"), seed, "r", "draw", "c"), "c")).alias("u"))
    at = first.join(d.select(F.col("block").alias("u"), "d"), "u")
    far = uniform(seed + 1, F.col("r"), F.col("draw")) < blocks / (F.col("d") + blocks)
    second = at.where(~far).join(cells.select(F.col("r").alias("u"), F.col("c").alias("s"), "m"), "u").where("s <> r")
    near = second.groupBy("r", "draw").agg(F.min_by("s", F.struct(race(F.col("m"), seed + 2, "r", "draw", "s"), "s")).alias("s"))
    # one of the others, by number; also for those whose neighbour has no other
    rest = at.join(near.select("r", "draw"), ["r", "draw"], "left_anti")
    drawn = F.floor(uniform(seed + 3, F.col("r"), F.col("draw")) * (blocks - 1)).cast("long")
    rest = rest.select("r", "draw", (drawn + F.when(drawn >= F.col("r"), 1).otherwise(0)).alias("s"))
    both = near.unionByName(rest).where((F.col("s") >= 0) & (F.col("s") < blocks))
    return both.select(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).distinct()


def best_merges(deltas: DataFrame) -> DataFrame:
    """``block, partner, delta``: of each block the merge that costs least, ties going to the smaller partner."""
    both = deltas.select(F.col("r").alias("block"), F.col("s").alias("partner"), "delta").unionByName(deltas.select(F.col("s").alias("block"), F.col("r").alias("partner"), "delta"))
    return both.groupBy("block").agg(F.min_by("partner", F.struct("delta", "partner")).alias("partner"), F.min("delta").alias("delta"))


def chosen_merges(best: DataFrame, merges: int) -> DataFrame:
    """``block, partner`` of the ``merges`` cheapest merges that join different blocks, ties going to the smaller block.

    Blocks that are each other's best offer one merge twice. A longer circle of best merges there can't be: its costs would
    all be equal, and each block would have taken the smaller of two equal partners. So without the second of such twins no
    merge joins what others have joined, and the cheapest are the first by cost.
    """
    other = best.select(F.col("block").alias("partner"), F.col("partner").alias("block"), F.lit(True).alias("twin"))
    once = best.join(other, ["block", "partner"], "left").where("twin is null or block < partner").select("block", "partner", "delta")
    place = dense_ids(once, ["delta", "block"], "block").where(F.col("place") < merges)
    return once.join(place.select("block"), "block", "left_semi").select("block", "partner")


def merged_names(best: DataFrame, merges: int) -> DataFrame:
    """``block, new`` of every block in the ``merges`` cheapest merges: what merges gets the smallest of its names.

    A block points to its partner, and pointers are followed two at a time until they end, so the rounds are the logarithm
    of the longest row of blocks that merge.
    """
    up = cut(chosen_merges(best, merges).select("block", F.col("partner").alias("top")), "pointers")
    while True:
        higher = up.select(F.col("block").alias("top"), F.col("top").alias("next"))
        now = cut(up.join(higher, "top", "left").select("block", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), "pointers")
        if not now.where("moved").limit(1).count():
            break
        up = now.select("block", "top")
    names = up.select("block", "top").unionByName(up.select(F.col("top").alias("block"), "top")).groupBy("top").agg(F.min("block").alias("new"))
    return up.join(names, "top").select("block", "new").unionByName(names.select(F.col("top").alias("block"), "new"))


def carry_out(labels: DataFrame, best: DataFrame, merges: int) -> DataFrame:
    """``labels`` after the ``merges`` cheapest merges that join different blocks; blocks keep the smallest name."""
    return labels.join(merged_names(best, merges), "block", "left").select("node", F.coalesce("new", "block").alias("block"))

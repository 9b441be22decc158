"""Block matrices ``r, c, m`` of edges ``src, dst, weight`` under labels ``node, block``, and their entropy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import xlogx
from sparkloom.operators.matrix import dense_ids
from sparkloom.plans.shared import cut


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def identity_labels(edges: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Each node a block of its own; nodes that only ``truth`` has are there too."""
    nodes = nodes_of(edges)
    if truth is not None:
        nodes = nodes.union(truth.select("node")).distinct()
    return nodes.select("node", F.col("node").alias("block"))


def dense_blocks(labels: DataFrame, m: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """Labels whose blocks are named 0, 1, 2, ... in the order of their names, the matrix alike, and the number of blocks."""
    names = cut(dense_ids(labels.select("block").distinct().withColumn("by", F.col("block")), ["by"], "block").withColumnRenamed("place", "new"), "names")
    return cut(labels.join(names, "block").select("node", F.col("new").alias("block")), "labels"), None if m is None else cut(renamed(m, names), "matrix"), names.count()


def renamed(m: DataFrame, names: DataFrame) -> DataFrame:
    """``m`` with the blocks that ``names`` (``block, new``) gives; blocks of one new name become one."""
    left, right = names.select(F.col("block").alias("r"), F.col("new").alias("r2")), names.select(F.col("block").alias("c"), F.col("new").alias("c2"))
    return m.join(left, "r").join(right, "c").groupBy(F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.sum("m").alias("m"))


def edge_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weight between blocks: ``r, c, m``. Nodes without a label are left out."""
    left = labels.select(F.col("node").alias("src"), F.col("block").alias("r"))
    right = labels.select(F.col("node").alias("dst"), F.col("block").alias("c"))
    # weights of a node and a block are summed before the second join
    half = edges.join(left, "src").groupBy("r", "dst").agg(F.sum("weight").alias("m"))
    return half.join(right, "dst").groupBy("r", "c").agg(F.sum("m").alias("m"))


def degrees(m: DataFrame) -> DataFrame:
    """``block, d_out, d_in, d``."""
    ends = m.select(F.col("r").alias("block"), F.col("m").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(m.select(F.col("c").alias("block"), F.lit(0).cast("long").alias("o"), F.col("m").alias("i")))
    return ends.groupBy("block").agg(F.sum("o").alias("d_out"), F.sum("i").alias("d_in"), F.sum(F.col("o") + F.col("i")).alias("d"))


def data_entropy(m: DataFrame) -> DataFrame:
    """One row, ``entropy``: the sum of -m ln(m / (d_out d_in)), which is three sums of x ln x; M meets no degrees."""
    d = degrees(m)
    terms = m.select((-xlogx(F.col("m"))).alias("t")).unionByName(d.select((xlogx(F.col("d_out")) + xlogx(F.col("d_in"))).alias("t")))
    return terms.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("entropy"))


def row_entropy(m: DataFrame, leave_out: list[int] | None = None) -> DataFrame:
    """``r, entropy`` of each row, without the columns in ``leave_out``."""
    d = degrees(m)
    cells = m.where(~F.col("c").isin(leave_out)) if leave_out else m
    joined = cells.join(d.select(F.col("block").alias("r"), "d_out"), "r").join(d.select(F.col("block").alias("c"), "d_in"), "c")
    return joined.groupBy("r").agg(F.sum(-F.col("m") * F.ln(F.col("m") / (F.col("d_out") * F.col("d_in")))).alias("entropy"))


def model_entropy(blocks: int, nodes: int, edges: float, form: str = "documented") -> float:
    """What the model itself costs. ``as_coded`` multiplies the first of its two terms alone by the edges."""
    if blocks < 1 or edges <= 0:
        return 0.0
    x = blocks * blocks / edges
    first, second = (1 + x) * math.log(1 + x), x * math.log(x)
    own = edges * first - second if form == "as_coded" else edges * (first - second)
    return own + nodes * math.log(blocks)


def overall_entropy(m: DataFrame, blocks: int, nodes: int, edges: float, form: str = "documented") -> float:
    return model_entropy(blocks, nodes, edges, form) + float(data_entropy(m).first()["entropy"])


def check_state(m: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells where ``m`` and the matrix counted anew differ; empty if the state is right."""
    fresh = edge_counts(edges, labels).withColumnRenamed("m", "fresh")
    return m.join(fresh, ["r", "c"], "full").where(F.coalesce("m", F.lit(0)) != F.coalesce("fresh", F.lit(0)))


def fold_edges(m: DataFrame, new_edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``m`` with the weights of ``new_edges`` added."""
    return m.unionByName(edge_counts(new_edges, labels)).groupBy("r", "c").agg(F.sum("m").alias("m"))

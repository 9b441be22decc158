"""Graphs with planted blocks, and their cutting into stages of a stream. All draws are hashes of the seed and ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import block_affinity, power_law, uniform
from sparkloom.operators.matrix import dense_ids
from sparkloom.plans.shared import cut, new_path


def planted_blocks(spark: SparkSession, nodes: int, blocks: int, seed: int = 1, concentration: float = 10.0) -> DataFrame:
    """``node, block`` from 1: block sizes by a Dirichlet draw, members by lookup of a uniform in its running sums."""
    share = np.random.default_rng(seed).dirichlet([concentration] * blocks)
    bounds = F.array(*[F.lit(float(x)) for x in np.cumsum(share)])
    u = uniform(seed, 10, F.col("node"))
    rows = spark.range(1, nodes + 1).select(F.col("id").alias("node"))
    return rows.select("node", F.least(F.size(F.filter(bounds, lambda b: b <= u)) + 1, F.lit(blocks)).cast("long").alias("block"))


def block_graph(labels: DataFrame, seed: int = 1, exponent: float = -2.5, low: int = 4, high: int = 30, within: float = 3.0, between: float = 1.0, density: float = 1.0, exponent_in: float | None = None) -> DataFrame:
    """``src, dst, weight``: nodes have power-law numbers of stubs; a stub goes to a block by affinity and in it to a node by
    its stubs (a degree-corrected block model in expectation); repeated edges and loops go; ``density`` thins what is left.
    With ``exponent_in`` a node's ends for edges that come in are drawn apart from its stubs, by a law of their own.
    """
    stubs = labels.select("node", "block", power_law(uniform(seed, 1, F.col("node")), exponent, low, high).alias("k"))
    # targets: every stub end numbered in its block
    ends = stubs.select("node", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("copy"))
    into = ends
    if exponent_in is not None:
        drawn = labels.select("node", "block", power_law(uniform(seed, 5, F.col("node")), exponent_in, low, high).alias("k"))
        into = drawn.select("node", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("copy"))
    placed = dense_ids(into.withColumn("id", F.struct("block", "node", "copy")), ["id"], "id")
    targets = cut(placed.select(F.col("id.block").alias("to"), F.col("id.node").alias("dst"), "place"), "targets")
    sizes = targets.groupBy("to").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    aims = block_aims(sizes, within, between)
    out = ends.withColumn("u", uniform(seed, 2, F.col("node"), F.col("copy")))
    # inside the block, or to a place among the ends of all others
    chosen = out.join(aims.withColumnRenamed("to", "block"), "block")
    within_own = F.col("u") < F.col("own_share")
    v = (F.col("u") - F.col("own_share")) / F.greatest(1 - F.col("own_share"), F.lit(1e-300))
    far = F.floor(v * (F.col("whole") - F.col("size"))).cast("long")
    near = (F.col("first") + F.floor(uniform(seed, 3, F.col("node"), F.col("copy")) * F.col("size"))).cast("long")
    aimed = chosen.select("node", "copy", F.when(within_own, near).otherwise(F.when(far < F.col("first"), far).otherwise(far + F.col("size"))).alias("place"))
    edges = aimed.join(targets, "place").select(F.col("node").alias("src"), "dst").where("src <> dst").distinct()
    if density < 1:
        edges = edges.where(uniform(seed, 4, F.col("src"), F.col("dst")) < density)
    return edges.withColumn("weight", F.lit(1).cast("long"))


def block_aims(sizes: DataFrame, within: float, between: float) -> DataFrame:
    """``to, size, first, own_share, whole``: the chance that a stub of a block stays in it, of blocks ``to, size, first``.

    The affinity of every other block is the same, so a stub that leaves goes to any end outside alike: one number a block
    stands for its row of the affinity matrix, which is never made.
    """
    whole = sizes.agg(F.sum("size").alias("whole"))
    apart = block_affinity(F.lit(1), F.lit(2), within, between)
    every = sizes.crossJoin(whole)  # one row on the right
    outside = (F.col("whole") - F.col("size")) * apart
    return every.select("to", "size", "first", "whole", (F.col("size") / (F.col("size") + outside)).alias("own_share"))


def within_between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: edges inside blocks and between them."""
    from sparkloom.operators.blocks.state import edge_counts

    m = edge_counts(edges, labels)
    return m.agg(F.coalesce(F.sum(F.when(F.col("r") == F.col("c"), F.col("m"))), F.lit(0)).alias("within"), F.coalesce(F.sum(F.when(F.col("r") != F.col("c"), F.col("m"))), F.lit(0)).alias("between"))


def emerging_stages(edges: DataFrame, stages: int, seed: int = 1) -> DataFrame:
    """Adds ``stage`` from 1, at random for each edge."""
    return edges.withColumn("stage", (F.floor(uniform(seed, 20, F.col("src"), F.col("dst")) * stages) + 1).cast("int"))


def snowball_depth(edges: DataFrame, start: int | None = None) -> DataFrame:
    """``node, depth``: breadth-first steps from ``start``, by default the node of most edges; unreached nodes are left out.

    Every step that reaches a new node is taken. A step's front is written as a partition of its own, so what has been
    seen is read and not written anew.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    ends = cut(ends.where("a <> b"), "ends")
    if start is None:
        top = ends.groupBy("a").count().orderBy(F.desc("count"), "a").first()
        if top is None:
            return ends.select(F.col("a").alias("node"), F.lit(0).alias("depth"))
        start = top["a"]
    kind = dict(ends.dtypes)["a"]
    path, schema = new_path(spark, "fronts"), f"node {kind}, depth int"
    spark.createDataFrame([(start,)], f"node {kind}").write.parquet(f"{path}/depth=0")
    depth = 0
    while True:
        seen = spark.read.schema(schema).parquet(path)
        front = seen.where(F.col("depth") == depth).select(F.col("node").alias("a"))
        new = ends.join(front, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        depth += 1
        new.write.parquet(f"{path}/depth={depth}")
        if not spark.read.schema(f"node {kind}").parquet(f"{path}/depth={depth}").limit(1).count():
            return spark.read.schema(schema).parquet(path)


def snowball_stages(edges: DataFrame, stages: int) -> DataFrame:
    """Adds ``stage``: nodes in breadth-first order in equal parts; an edge comes when both its ends are there."""
    depth = snowball_depth(edges)
    order = cut(dense_ids(depth.withColumn("id", F.col("node")), ["depth", "id"], "node"), "order")
    n = order.count()
    staged = order.select("node", (F.floor(F.col("place") * stages / max(1, n)) + 1).cast("int").alias("at"))
    both = edges.join(staged.select(F.col("node").alias("src"), F.col("at").alias("s1")), "src", "left").join(staged.select(F.col("node").alias("dst"), F.col("at").alias("s2")), "dst", "left")
    return both.withColumn("stage", F.greatest(F.coalesce("s1", F.lit(stages)), F.coalesce("s2", F.lit(stages)))).select(*edges.columns, "stage")


def arrival_ids(staged: DataFrame) -> DataFrame:
    """``node, new``: ids from 1 in the order of first stage, then of the old id."""
    first = staged.select(F.explode(F.array("src", "dst")).alias("node"), "stage").groupBy("node").agg(F.min("stage").alias("first"))
    return dense_ids(first.withColumn("id", F.col("node")), ["first", "id"], "node").select("node", (F.col("place") + 1).alias("new"))


def reindex(staged: DataFrame, ids: DataFrame) -> DataFrame:
    """``staged`` with the ids that ``ids`` gives."""
    left, right = ids.select(F.col("node").alias("src"), F.col("new").alias("src2")), ids.select(F.col("node").alias("dst"), F.col("new").alias("dst2"))
    rest = [c for c in staged.columns if c not in ("src", "dst")]
    return staged.join(left, "src").join(right, "dst").select(F.col("src2").alias("src"), F.col("dst2").alias("dst"), *rest)

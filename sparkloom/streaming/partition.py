"""Partitioning a graph that arrives in pieces, with Structured Streaming.

The order of a file source is not that of the piece numbers, so where order matters (``incremental``) pieces are fed by
number; ``naive`` and ``running_counts`` give the same whatever the order. A batch may be replayed after a failure: every
batch writes to a folder of its own number, so a replay replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.blocks.evaluate import evaluate
from sparkloom.operators.blocks.moves import settle
from sparkloom.operators.blocks.search import Bracket, Point, Result, partition, settled_point
from sparkloom.operators.blocks.state import edge_counts, fold_edges, nodes_of, overall_entropy
from sparkloom.operators.matrix import dense_ids
from sparkloom.plans.shared import cut

EDGES = "src long, dst long, weight long"


def edge_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    rows = spark.readStream.schema(EDGES).option("sep", "\t").option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return rows.withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))


def naive(stream: DataFrame, store: str, on_piece: Callable[[int, Result], None], **options):
    """After each batch the whole graph so far is partitioned anew. ``store``: folder of the edges so far."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        edges = spark.read.parquet(store).where(F.col("batch") <= number).drop("batch")
        on_piece(number, partition(edges, **options))

    return stream.writeStream.foreachBatch(take)


def running_counts(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """A streaming ``r, c, m``: the block matrix of all edges so far, for complete or update mode."""
    left, right = labels.select(F.col("node").alias("src"), F.col("block").alias("r")), labels.select(F.col("node").alias("dst"), F.col("block").alias("c"))
    return stream.join(left, "src").join(right, "dst").groupBy("r", "c").agg(F.sum("weight").alias("m"))


@dataclass
class State:
    """What goes on from piece to piece."""

    edges: DataFrame
    bracket: Bracket


def with_new_nodes(point: Point, edges: DataFrame, piece: DataFrame, nodes: DataFrame, n_edges: float, batches: int, seed: int, most_sweeps: int = 100) -> Point:
    """``point`` on a graph that ``piece`` has grown: new nodes are blocks of their own, and all nodes settle.

    The piece's edges are folded into the point's matrix; ``edges`` are all so far, ``nodes`` their nodes.
    """
    fresh = dense_ids(nodes.join(point.labels, "node", "left_anti").select("node", F.col("node").alias("by")), ["by"], "node")
    labels = cut(point.labels.unionByName(fresh.select("node", (F.col("place") + point.blocks).alias("block"))), "labels")
    m = cut(fold_edges(point.m, piece, labels), "matrix")
    n = labels.count()
    blocks = point.blocks + n - point.labels.count()
    done = settle(edges, labels, blocks, n, n_edges, 5e-4, seed, batches, most_sweeps, m=m)
    return settled_point(done, blocks, n, n_edges)


def add_piece(state: State | None, piece: DataFrame, finish: bool = True, seed: int = 1, batches: int = 4, **options) -> tuple[State, Result]:
    """Fold a piece's edges in, let the points of the bracket settle, and go on with the search.

    The state returned stops at the bracket; the result is of the search carried to its end, or of the state itself if
    ``finish`` is false. DataFrames do not change, so nothing has to be copied for that.
    """
    if state is None:
        edges = cut(piece, "edges")
        found = partition(edges, seed=seed, batches=batches, stop_at_bracket=True, **options)
    else:
        piece = cut(piece.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "piece")
        edges = cut(state.edges.unionByName(piece).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
        n_edges = float(edges.agg(F.sum("weight")).first()[0])
        nodes = cut(nodes_of(edges), "nodes")
        bracket = Bracket()
        for p in state.bracket.points:
            bracket.put(with_new_nodes(p, edges, piece, nodes, n_edges, batches, seed, options.get("most_sweeps", 100)))
        if nodes.count() > state.bracket.best.labels.count():
            # new nodes come as blocks of their own, so what has fewer blocks than the best was not merged there and bounds nothing
            bracket = Bracket({n: p for n, p in bracket.tried.items() if n >= bracket.best.blocks})
        found = partition(edges, seed=seed, batches=batches, resume=bracket, stop_at_bracket=True, **options)
    state = State(edges, found.bracket)
    if not finish:
        return state, found
    return state, partition(edges, seed=seed, batches=batches, resume=Bracket(dict(found.bracket.tried)), **options)


def incremental(pieces: list[DataFrame], on_piece: Callable[[int, Result], None], halving: bool = False, **options) -> State:
    """The pieces in their order, each folded into what the ones before left.

    halving: the search of a piece stops at a least number of blocks, half the nodes for the first and half of that before
    for each next, so early pieces, which say little, are not merged far.
    """
    state, least = None, 0
    for number, piece in enumerate(pieces, 1):
        if halving:
            least = nodes_of(piece).count() // 2 if state is None else least // 2
            options["min_blocks"] = least
        state, found = add_piece(state, piece, **options)
        on_piece(number, found)
    return state


def evaluate_observed(truth: DataFrame, found: DataFrame) -> dict[str, float]:
    """How well ``found`` agrees with ``truth`` on the nodes seen so far; the others are left out, and counted."""
    seen = truth.join(found.select("node"), "node", "left_semi")
    return evaluate(seen, found) | {"unseen": float(truth.join(found.select("node"), "node", "left_anti").count())}


def entropy_of(edges: DataFrame, labels: DataFrame) -> float:
    n = labels.select("block").distinct().count()
    return overall_entropy(edge_counts(edges, labels), n, labels.count(), float(edges.agg(F.sum("weight")).first()[0]))

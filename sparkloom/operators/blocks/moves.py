"""Moving nodes between blocks: proposals, their entropy and Hastings terms, and sweeps in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import clamp, race, uniform, xlogx
from sparkloom.operators.blocks.state import degrees, edge_counts, model_entropy, data_entropy
from sparkloom.operators.matrix import dense_ids
from sparkloom.plans.shared import cut

BETA = 3.0


def ends_of(edges: DataFrame) -> DataFrame:
    """``node, other, k_out, k_in``: each edge from both its ends, loops left out."""
    plain, zero = edges.where("src <> dst"), F.lit(0).cast("long")
    ends = plain.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("weight").alias("k_out"), zero.alias("k_in"))
    return ends.unionByName(plain.select(F.col("dst").alias("node"), F.col("src").alias("other"), zero.alias("k_out"), F.col("weight").alias("k_in")))


def blocks_around(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, t, k_out, k_in`` of ``ends``: weight between a node and each block."""
    block = labels.select(F.col("node").alias("other"), F.col("block").alias("t"))
    return ends.join(block, "other").groupBy("node", "t").agg(F.sum("k_out").alias("k_out"), F.sum("k_in").alias("k_in"))


def neighbour_blocks(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, t, k_out, k_in``: weight between a node and each block, loops left out."""
    return blocks_around(ends_of(edges), labels)


def propose(m: DataFrame, around: DataFrame, labels: DataFrame, blocks: int, seed: int, turn: int, d: DataFrame | None = None) -> DataFrame:
    """``node, r, s``: a new block for each node that has a neighbour; blocks are named 0 to ``blocks - 1``.

    A neighbour's block u is drawn by weight; then, with probability B / (d(u) + B) any other block, else one that u has
    edges with, by weight. Nodes without a choice are left out.
    """
    first = around.groupBy("node").agg(F.min_by("t", F.struct(race(F.col("k_out") + F.col("k_in"), seed, turn, "node", "t"), "t")).alias("u"))
    at = first.join(labels.select("node", F.col("block").alias("r")), "node").join((degrees(m) if d is None else d).select(F.col("block").alias("u"), "d"), "u")
    anywhere = uniform(seed + 1, turn, F.col("node")) < blocks / (F.col("d") + blocks)
    cells = m.unionByName(m.select(F.col("c").alias("r"), F.col("r").alias("c"), "m")).groupBy("r", "c").agg(F.sum("m").alias("m"))
    # of each node's block u the choices by weight; a node without any draws by number
    near = at.join(cells.select(F.col("r").alias("u"), F.col("c").alias("s"), "m"), "u").withColumn("far", anywhere)
    open_ = ~F.col("far") & (F.col("s") != F.col("r"))
    wait = race(F.col("m"), seed + 2, turn, "node", "s")
    chosen = near.groupBy("node", "r").agg(F.min_by(F.when(open_, F.col("s")), F.when(open_, F.struct(wait, F.col("s")))).alias("s"))
    drawn = F.floor(uniform(seed + 3, turn, F.col("node")) * (blocks - 1)).cast("long")
    drawn = drawn + F.when(drawn >= F.col("r"), 1).otherwise(0)
    return chosen.select("node", "r", F.coalesce("s", drawn).alias("s")).where((F.col("s") >= 0) & (F.col("s") < blocks))


def cell_changes(proposed: DataFrame, around: DataFrame, loops: DataFrame) -> DataFrame:
    """``node, x, y, by``: how each cell of M changes when the node moves from ``r`` to ``s``. loops: ``node, w``."""
    k = proposed.join(around, "node")
    change = lambda x, y, by: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), by.alias("by"))
    parts = F.array(change("r", "t", -F.col("k_out")), change("s", "t", F.col("k_out")), change("t", "r", -F.col("k_in")), change("t", "s", F.col("k_in")))
    own = proposed.join(loops, "node")
    looped = F.array(change("r", "r", -F.col("w")), change("s", "s", F.col("w")))
    rows = k.select("node", F.explode(parts).alias("e")).unionByName(own.select("node", F.explode(looped).alias("e")))
    return rows.groupBy("node", F.col("e.x").alias("x"), F.col("e.y").alias("y")).agg(F.sum("e.by").alias("by")).where("by <> 0")


def loops_of(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"))


def move_deltas(m: DataFrame, proposed: DataFrame, around: DataFrame, loops: DataFrame, changes: DataFrame | None = None, d: DataFrame | None = None) -> DataFrame:
    """``node, r, s, delta``: how the data entropy grows with each move alone; ``changes`` and ``d`` where they are known."""
    cells = m.select(F.col("r").alias("x"), F.col("c").alias("y"), "m")
    changes = cell_changes(proposed, around, loops) if changes is None else changes
    changed = changes.join(cells, ["x", "y"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    of_cells = changed.groupBy("node").agg(F.sum(xlogx(F.col("m")) - xlogx(F.col("m") + F.col("by"))).alias("of_cells"))
    k = around.groupBy("node").agg(F.sum("k_out").alias("o"), F.sum("k_in").alias("i")).join(loops, "node", "left").select("node", (F.col("o") + F.coalesce("w", F.lit(0))).alias("o"), (F.col("i") + F.coalesce("w", F.lit(0))).alias("i"))
    d = degrees(m) if d is None else d
    p = proposed.join(k, "node").join(d.select(F.col("block").alias("r"), F.col("d_out").alias("ro"), F.col("d_in").alias("ri")), "r").join(d.select(F.col("block").alias("s"), F.col("d_out").alias("so"), F.col("d_in").alias("si")), "s")
    x = lambda now, then: xlogx(then) - xlogx(now)
    of_degrees = sum((x(F.col(a), F.col(a) + sign * F.col(b)) for a, b, sign in (("ro", "o", -1), ("so", "o", 1), ("ri", "i", -1), ("si", "i", 1))), F.lit(0.0))
    return p.select("node", "r", "s", of_degrees.alias("of_degrees")).join(of_cells, "node", "left").select("node", "r", "s", (F.col("of_degrees") + F.coalesce("of_cells", F.lit(0.0))).alias("delta"))


def hastings(m: DataFrame, proposed: DataFrame, around: DataFrame, loops: DataFrame, blocks: int, changes: DataFrame | None = None, d: DataFrame | None = None) -> DataFrame:
    """``node, ratio``: the chance to be proposed the way back over that of the move."""
    cells = m.select(F.col("r").alias("x"), F.col("c").alias("y"), "m")
    changes = cell_changes(proposed, around, loops) if changes is None else changes
    d = (degrees(m) if d is None else d).select(F.col("block").alias("t"), "d")
    k = around.groupBy("node").agg(F.sum(F.col("k_out") + F.col("k_in")).alias("k")).join(loops, "node", "left").select("node", (F.col("k") + 2 * F.coalesce("w", F.lit(0))).alias("k"))
    base = proposed.join(around, "node").join(d, "t").join(k, "node")
    moved = F.col("d") - F.when(F.col("t") == F.col("r"), F.col("k")).otherwise(0) + F.when(F.col("t") == F.col("s"), F.col("k")).otherwise(0)
    base = base.select("node", "r", "s", "t", (F.col("k_out") + F.col("k_in")).alias("w"), F.col("d").alias("d_now"), moved.alias("d_then"))
    look = lambda x, y, then: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(then).alias("then"))
    wanted = base.select("*", F.explode(F.array(look("t", "s", False), look("s", "t", False), look("t", "r", True), look("r", "t", True))).alias("e")).select("node", "t", "w", "d_now", "d_then", "e.*")
    seen = wanted.join(cells, ["x", "y"], "left").join(changes, ["node", "x", "y"], "left")
    value = F.coalesce("m", F.lit(0)) + F.when(F.col("then"), F.coalesce("by", F.lit(0))).otherwise(0)
    by_block = seen.groupBy("node", "t", "w", "d_now", "d_then").agg(F.sum(F.when(~F.col("then"), value).otherwise(0)).alias("now"), F.sum(F.when(F.col("then"), value).otherwise(0)).alias("after"))
    terms = by_block.groupBy("node").agg(F.sum(F.col("w") * (F.col("now") + 1) / (F.col("d_now") + blocks)).alias("there"), F.sum(F.col("w") * (F.col("after") + 1) / (F.col("d_then") + blocks)).alias("back"))
    return terms.select("node", (F.col("back") / F.col("there")).alias("ratio"))


def fold_moves(m: DataFrame, edges: DataFrame, labels: DataFrame, taken: DataFrame) -> DataFrame:
    """``m`` after the nodes of ``taken`` (``node, s``) have moved: only edges with an end that moves are looked at.

    labels: as before the moves. An edge takes its weight from the cell of its old blocks to that of its new ones, so moves
    of both ends at once are right as well.
    """
    first, second = (taken.select(F.col("node").alias(end)) for end in ("src", "dst"))
    touched = edges.join(first, "src", "left_semi").unionByName(edges.join(first, "src", "left_anti").select(edges.columns).join(second, "dst", "left_semi"))
    both = labels.join(taken.select("node", "s"), "node", "left").select("node", F.col("block").alias("old"), F.coalesce("s", "block").alias("new"))
    for end, old, new in (("src", "r", "r2"), ("dst", "c", "c2")):
        touched = touched.join(both.select(F.col("node").alias(end), F.col("old").alias(old), F.col("new").alias(new)), end)
    change = F.array(F.struct("r", "c", (-F.col("weight")).alias("m")), F.struct(F.col("r2").alias("r"), F.col("c2").alias("c"), F.col("weight").alias("m")))
    changes = touched.select(F.explode(change).alias("e")).select("e.*")
    return m.unionByName(changes).groupBy("r", "c").agg(F.sum("m").alias("m")).where("m <> 0")


@dataclass
class Sweep:
    labels: DataFrame
    moves: int
    delta: float
    m: DataFrame


def sweep(edges: DataFrame, labels: DataFrame, blocks: int, seed: int, turn: int, batches: int = 4, beta: float = BETA, m: DataFrame | None = None, ends: DataFrame | None = None) -> Sweep:
    """One pass over all nodes: those of a batch propose against the same matrix and move together.

    Blocks are named 0 to ``blocks - 1``. Batches and draws are hashes of seed, turn and node, so a run can be repeated under
    any partitioning. ``m`` is the matrix of the labels; what a batch moves is folded into it.
    """
    loops, ends = loops_of(edges), ends_of(edges) if ends is None else ends
    m = cut(edge_counts(edges, labels), "matrix") if m is None else m
    moves, delta = 0, 0.0
    for batch in range(batches):
        mine = labels.where(F.floor(uniform(seed, turn, F.col("node")) * F.lit(batches)) == batch)
        around = blocks_around(ends.join(mine.select("node"), "node", "left_semi"), labels).persist()
        d = degrees(m).persist()
        proposed = propose(m, around, mine, blocks, seed, turn * batches + batch, d).persist()
        changes = cell_changes(proposed, around, loops).persist()
        judged = move_deltas(m, proposed, around, loops, changes, d).join(hastings(m, proposed, around, loops, blocks, changes, d), "node")
        chance = F.least(F.exp(-beta * clamp(F.col("delta"), -10.0, 10.0)) * F.col("ratio"), F.lit(1.0))
        taken = cut(judged.where(uniform(seed + 4, turn, F.col("node")) < chance).select("node", "s", "delta"), "moves")
        for held in (around, d, proposed, changes):
            held.unpersist()
        n, gain = taken.agg(F.count("*"), F.coalesce(F.sum("delta"), F.lit(0.0))).first()
        if n:
            m = cut(fold_moves(m, edges, labels, taken), "matrix")
            labels = cut(labels.join(taken.select("node", "s"), "node", "left").select("node", F.coalesce("s", "block").alias("block")), "labels")
            moves, delta = moves + n, delta + gain
    return Sweep(labels, moves, delta, m)


@dataclass
class Settled:
    labels: DataFrame
    m: DataFrame
    entropy: float
    sweeps: int


def settle(edges: DataFrame, labels: DataFrame, blocks: int, nodes: int, n_edges: float, threshold: float, seed: int, batches: int = 4, most: int = 100, window: int = 3, least_moves: float = 0.0, form: str = "documented", m: DataFrame | None = None, ends: DataFrame | None = None) -> Settled:
    """Sweeps until few nodes move or the mean gain of the last sweeps is below ``threshold`` of the entropy.

    The mean leaves out the newest sweep, as the documented rule does.
    """
    gains: list[float] = []
    m = cut(edge_counts(edges, labels), "matrix") if m is None else m
    ends = cut(ends_of(edges), "ends") if ends is None else ends
    for turn in range(most):
        done = sweep(edges, labels, blocks, seed, turn, batches, m=m, ends=ends)
        labels, m = done.labels, done.m
        gains.append(done.delta)
        entropy = model_entropy(blocks, nodes, n_edges, form) + float(data_entropy(m).first()["entropy"])
        if done.moves <= nodes * least_moves:
            break
        recent = gains[-window:-1]
        if len(gains) >= window and -sum(recent) / len(recent) < threshold * entropy:
            break
    return Settled(labels, m, entropy, turn + 1)


def round_robin(labels: DataFrame) -> DataFrame:
    """``node, place``: nodes in the order of a round over the blocks, the first of each, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy("block").orderBy("node"))
    return dense_ids(labels.select("node", "block", turn.alias("turn")), ["turn", "block"], "node")


def stride_order(nodes: DataFrame, stride: int) -> DataFrame:
    """``node, place``: every ``stride``-th node in the order of ids, then those after them, so neighbours in it lie far apart."""
    placed = dense_ids(nodes.select("node", F.col("node").alias("by")), ["by"], "node")
    return dense_ids(placed.select("node", (F.col("place") % stride).alias("rest"), F.col("place").alias("by")), ["rest", "by"], "node")

"""The search for the number of blocks: merge and settle, with a golden-section bracket."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.blocks.local import partition_local
from sparkloom.operators.blocks.merges import adjacent_pairs, best_merges, delta_entropy, merged_names, sampled_pairs
from sparkloom.operators.blocks.moves import Settled, ends_of, settle
from sparkloom.operators.blocks.state import dense_blocks, edge_counts, identity_labels, model_entropy, overall_entropy, renamed
from sparkloom.plans.shared import cut

GOLDEN = 0.61803399


@dataclass
class Point:
    """Labels of one number of blocks, their entropy, and the block matrix where it is known."""

    labels: DataFrame | None = None
    entropy: float = math.inf
    blocks: int = 0
    m: DataFrame | None = None


@dataclass
class Bracket:
    """What has been tried, by number of blocks; the best, and the nearest tried on both its sides, bound the search."""

    tried: dict[int, Point] = field(default_factory=dict)

    def put(self, p: Point) -> None:
        held = self.tried.get(p.blocks)
        if held is None or p.entropy <= held.entropy:
            self.tried[p.blocks] = p

    @property
    def best(self) -> Point:
        return min(self.tried.values(), key=lambda p: (p.entropy, p.blocks), default=Point())

    @property
    def more(self) -> Point | None:
        """The tried point of least blocks above the best."""
        return min((p for p in self.tried.values() if p.blocks > self.best.blocks), key=lambda p: p.blocks, default=None)

    @property
    def fewer(self) -> Point | None:
        """The tried point of most blocks below the best."""
        return max((p for p in self.tried.values() if p.blocks < self.best.blocks), key=lambda p: p.blocks, default=None)

    @property
    def points(self) -> list[Point]:
        return [p for p in (self.more, self.best, self.fewer) if p is not None]

    @property
    def closed(self) -> bool:
        return self.fewer is not None

    def next(self, rate: float) -> tuple[Point, int]:
        """Where to go on from, and how many blocks to merge away; 0: the search is over.

        Until a point below the best is worse, a share of the best's blocks goes; then the wider side of the best is cut by
        the golden ratio.
        """
        if not self.closed:
            return self.best, int(self.best.blocks * rate)
        around = self.points
        sides = sorted(zip(around, around[1:], strict=False), key=lambda side: side[1].blocks - side[0].blocks)
        start, end = sides[0]
        target = end.blocks + round((start.blocks - end.blocks) * GOLDEN)
        return (start, start.blocks - target) if end.blocks < target < start.blocks else (self.best, 0)

    def least_by_parabola(self) -> float | None:
        """The number of blocks at which a parabola through the three points is least; None where there is none."""
        if len(self.points) < 3:
            return None
        (x1, y1), (x2, y2), (x3, y3) = ((float(p.blocks), p.entropy) for p in self.points)
        one, two = (y2 - y1) / (x2 - x1), (y3 - y2) / (x3 - x2)
        bend = (two - one) / (x3 - x1)
        return (x1 + x2) / 2 - one / (2 * bend) if bend > 0 else None

    def slope(self) -> float | None:
        """How much the entropy changes with a block, from the best to the nearer of its neighbours."""
        best = self.best
        near = min((p for p in self.points if p is not best), key=lambda p: abs(p.blocks - best.blocks), default=None)
        return None if near is None else abs(near.entropy - best.entropy) / abs(near.blocks - best.blocks)


@dataclass
class Result:
    labels: DataFrame
    blocks: int
    entropy: float
    bracket: Bracket


def as_dense(edges: DataFrame, point: Point) -> Point:
    """``point`` with blocks named 0, 1, 2, ... and its matrix."""
    if point.m is not None:
        return point
    labels, _, blocks = dense_blocks(point.labels)
    return Point(labels, point.entropy, blocks, cut(edge_counts(edges, labels), "matrix"))


def step(edges: DataFrame, start: Point, merges: int, nodes: int, n_edges: float, threshold: float, seed: int, batches: int = 4, proposals: int | None = None, most_sweeps: int = 100, least_moves: float = 0.0, form: str = "documented", ends: DataFrame | None = None) -> Point:
    """Merge away blocks of ``start``, then let the nodes settle. The matrix follows merges and moves, and is not counted anew.

    Each block offers its best merge, of which twins are one; where that is less than is to go, the merged blocks offer again.
    """
    start = as_dense(edges, start)
    labels, m, blocks, target = start.labels, start.m, start.blocks, start.blocks - merges
    while True:
        pairs = adjacent_pairs(m) if proposals is None else sampled_pairs(m, proposals, seed, blocks)
        merged = cut(merged_names(best_merges(delta_entropy(m, pairs)), blocks - target), "merged")
        every = labels.select("block").distinct().join(merged, "block", "left").select("block", F.coalesce("new", "block").alias("new"))
        m, before = renamed(m, every), blocks
        labels, m, blocks = dense_blocks(labels.join(merged, "block", "left").select("node", F.coalesce("new", "block").alias("block")), m)
        if blocks <= target or blocks == before:
            break
    done = settle(edges, labels, blocks, nodes, n_edges, threshold, seed, batches, most_sweeps, least_moves=least_moves, form=form, m=m, ends=ends)
    return settled_point(done, blocks, nodes, n_edges, form)


def settled_point(done: Settled, blocks: int, nodes: int, n_edges: float, form: str = "documented") -> Point:
    """What ``settle`` left of ``blocks`` blocks; where some are empty now, the others are numbered anew."""
    left = done.labels.select("block").distinct().count()
    labels, m = done.labels, done.m
    if left < blocks:
        labels, m, left = dense_blocks(labels, m)
    return Point(labels, done.entropy - model_entropy(blocks, nodes, n_edges, form) + model_entropy(left, nodes, n_edges, form), left, m)


def partition(edges: DataFrame, truth: DataFrame | None = None, *, seed: int = 1, rate: float = 0.5, first_rate: float | None = None, batches: int = 4, proposals: int | None = None, min_blocks: int = 0, stop_at_bracket: bool = False, resume: Bracket | None = None, most_sweeps: int = 100, least_moves: float = 0.0, least_slope: float = 0.0, form: str = "documented", n_edges: float | None = None, local: bool = False) -> Result:
    """Labels of least entropy that the search finds; blocks are named 0, 1, 2, ...

    local: search in one task, nodes moving one after another, for a graph that the caller knows to be small. Nothing else
    decides how a graph is searched.

    resume: the bracket of an earlier, stopped search. truth: only its nodes are used, so isolated ones count. least_slope: the
    search also ends where a block more or less changes the entropy by less.
    """
    edges = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    n_edges = float(edges.agg(F.sum("weight")).first()[0] or 0) if n_edges is None else n_edges
    if local:
        if resume is not None or stop_at_bracket or proposals is not None:
            raise ValueError("a search in one task can't be stopped, resumed or sampled")
        every = identity_labels(edges, truth)
        labels, _, blocks = dense_blocks(partition_local(edges, every, seed=seed, rate=rate, min_blocks=min_blocks, most_sweeps=most_sweeps, form=form))
        found = Point(labels, overall_entropy(edge_counts(edges, labels), blocks, labels.count(), n_edges, form), blocks)
        return Result(labels, blocks, found.entropy, Bracket({blocks: found}))
    ends = cut(ends_of(edges), "ends")
    if resume is None:
        labels, _, nodes = dense_blocks(identity_labels(edges, truth))
        m = cut(edge_counts(edges, labels), "matrix")
        bracket = Bracket()
        bracket.put(Point(labels, overall_entropy(m, nodes, nodes, n_edges, form), nodes, m))
    else:
        bracket = resume
        nodes = bracket.best.labels.count()
    turn, now_rate = 0, first_rate or rate
    while True:
        start, merges = bracket.next(now_rate)
        now_rate = rate
        if merges <= 0 or start.labels is None or start.blocks - merges < max(1, min_blocks) or stop_at_bracket and bracket.closed:
            break
        if least_slope and bracket.closed and bracket.slope() < least_slope:
            break
        threshold = 1e-4 if bracket.closed else 5e-4
        found = step(edges, start, merges, nodes, n_edges, threshold, seed + 101 * turn, batches, proposals, most_sweeps, least_moves, form, ends)
        if found.blocks >= start.blocks:
            break
        bracket.put(found)
        turn += 1
    best = bracket.best
    return Result(best.labels, best.blocks, best.entropy, bracket)


def partition_decimated(edges: DataFrame, parts: int, **options) -> Result:
    """Partitions the sub-graphs of ids that are congruent modulo ``parts``, then merges and settles on the whole graph."""
    from sparkloom.operators.matrix import decimate

    whole, offset = None, 0
    for part in range(parts):
        own = decimate(edges, parts, part)
        if not own.limit(1).count():
            continue
        found = partition(own, **options)
        labels = found.labels.select((F.col("node") * parts + part).alias("node"), (F.col("block") * parts + part).alias("block"))
        whole = labels if whole is None else whole.unionByName(labels)
        offset += found.blocks
    every = identity_labels(edges)
    labels = every if whole is None else every.select("node").join(whole, "node", "left").select("node", F.coalesce("block", "node").alias("block"))
    labels, _, blocks = dense_blocks(labels)
    nodes, n_edges = labels.count(), float(edges.agg(F.sum("weight")).first()[0])
    m = cut(edge_counts(edges, labels), "matrix")
    bracket = Bracket()
    bracket.put(Point(labels, overall_entropy(m, blocks, nodes, n_edges), blocks, m))
    return partition(edges, resume=bracket, **{k: v for k, v in options.items() if k != "local"})

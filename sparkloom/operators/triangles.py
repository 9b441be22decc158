"""Triangles of simple undirected graphs, given as edges ``a, b`` with ``a < b``.

How triangles are found is told in ``packed``: sorted lists of later neighbours, sent once a part of the graph, are met in
memory; no wedge is shuffled or written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import packed


def simple_edges(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct edges with ``a < b``, without loops."""
    return rows.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """``a < b < c`` of each triangle, once."""
    return packed.numbered(edges, packed.listed, ("a", "b", "c"))


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row; the triangles are not listed."""
    found = packed.numbered(edges, packed.counted, ())
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def triangle_count_algebra(adjacency: DataFrame) -> DataFrame:
    """A sixth of the sum of ``A² ∘ A``, from symmetric 0-1 triples ``i, j, v`` without loops.

    The six terms of a triangle are equal, so of each the one whose indices are in order is made, under the mask: no product
    is summed before it, and a sixth of the sum is the number of those terms.
    """
    return triangle_count(adjacency.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b")))


def triangle_count_lower(adjacency: DataFrame) -> DataFrame:
    """The sum of ``L L ∘ L`` for the lower triangle L of 0-1 triples, which has one term a triangle; the mask comes first."""
    from sparkloom.operators.matrix import lower

    return triangle_count(lower(adjacency).select(F.col("j").alias("a"), F.col("i").alias("b")))


def triangle_count_incidence(adjacency: DataFrame, incidence: DataFrame) -> DataFrame:
    """A third of the entries of ``A B`` that are 2, for symmetric A and an incidence matrix B of ``vertex, edge, v``.

    An entry counts the ends of the edge that the vertex is joined with; it can be 2 only if both are. So a side that is
    ``m`` edges of B gives ``m`` such entries where the other two sides are in A, whatever else is in A or B.
    """
    ends = edges_of_incidence(incidence).where("a <> b").select("a", "b", F.lit(2).cast("long").alias("w"))
    joined = adjacency.where("i < j and v <> 0").select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1).cast("long").alias("w"))

    def entries(*sides):
        # of each side twice its edges of B, and 1 if it is in A
        x, y, z = [((s >> np.uint64(1)).astype(np.int64), (s & np.uint64(1)).astype(np.int64)) for s in sides]
        return x[0] * y[1] * z[1] + y[0] * x[1] * z[1] + z[0] * x[1] * y[1]

    found = packed.numbered(joined.unionByName(ends), lambda e: packed.counted(e, "w", entries), ())
    return found.agg((F.coalesce(F.sum(F.col("key") * F.col("n")), F.lit(0)) / 3).cast("long").alias("triangles"))


def edges_of_wedges(edges: DataFrame) -> DataFrame:
    """``a, b, corners``: of each edge the list of vertices joined with both its ends, in order; edges without one are left out.

    It is the product of adjacency and incidence whose entries are joined to lists in place of being summed, of which only
    entries with two contributions stay.
    """
    if dict(edges.dtypes)["a"] in packed.INTEGERS:
        found = packed.numbered(edges, packed.cornered, ("a", "b"))
        return found.withColumn("corners", F.col("corners").cast(f"array<{dict(edges.dtypes)['a']}>"))
    found = packed.numbered(edges, lambda e: packed.cornered(e).select("a", "b", F.explode("corners").alias("x")), ("a", "b", "x"))
    return found.groupBy("a", "b").agg(F.sort_array(F.collect_list("x")).alias("corners"))


def vertex_degrees(found: DataFrame) -> DataFrame:
    """``vertex, triangles`` of each vertex that is in one."""
    return found.select(F.explode(F.array("a", "b", "c")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("triangles"))


def sides(found: DataFrame, *more: str) -> DataFrame:
    """``a, b, x``: each side of each triangle with the corner opposite, and the columns ``more``."""
    rows = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("x")) for p, q, r in ("abc", "acb", "bca")])
    return found.select(F.explode(rows).alias("s"), *more).select("s.*", *more)


def edge_degrees(found: DataFrame) -> DataFrame:
    """``a, b, triangles`` of each edge that is in one."""
    return sides(found).groupBy("a", "b").agg(F.count("*").alias("triangles"))


def edge_support(edges: DataFrame) -> DataFrame:
    """``a, b, support`` of every edge; 0 where it is in no triangle."""
    return edges.select("a", "b").join(edge_degrees(triangles(edges)), ["a", "b"], "left").select("a", "b", F.coalesce("triangles", F.lit(0)).cast("long").alias("support"))


def k_counts(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """``k, triangles``: by the largest clique each triangle could be in, judged by the degrees of its corners and sides.

    A triangle can be in a clique of k only if each corner is in C(k - 1, 2) triangles and each side in k - 2. An edge's degree
    and those of its ends make its bound, and a triangle has the least of its sides' bounds. Triangles are found twice, for
    the degrees and, by the edges with their bounds, for the counts; they are never written.
    """
    return packed.numbered(edges, lambda e: _k_counts(e, cap), ())


def _k_counts(edges: DataFrame, cap: int | None) -> DataFrame:
    from sparkloom.plans.shared import cut, discard, release

    spark = edges.sparkSession
    side = cut(packed.supported(edges), "support")
    release(spark)
    # a vertex is in half as many triangles as its edges together
    ends = side.select(F.explode(F.array("a", "b")).alias("x"), "triangles").groupBy("x").agg((F.sum("triangles") / 2).cast("long").alias("n"))
    ends = cut(ends.select("x", F.floor((3 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("bound")), "vertices")
    bounds = side.select("a", "b", (F.col("triangles") + 2).alias("k"))
    for end in "ab":
        bounds = bounds.join(ends.withColumnRenamed("x", end), end).select("a", "b", F.least("k", "bound").alias("k"))
    bounds = cut(bounds, "bounds")
    discard(side, ends)
    release(spark)
    found = packed.counted(bounds, "k", lambda x, y, z: np.minimum(np.minimum(x, y), z))
    k = F.col("key") if cap is None else F.least("key", F.lit(cap)).cast("long")
    return found.groupBy(k.alias("k")).agg(F.sum("n").cast("long").alias("triangles"))


def truss(edges: DataFrame, k: int) -> DataFrame:
    """The k-truss: what is left when edges in fewer than ``k - 2`` triangles go, until none does.

    An edge that is in a triangle keeps it, so for ``k = 3`` the triangles are counted once. Else each part of the graph writes
    its triangles, and edges with both ends in it go from them without a round; in a round the parts only tell in how many
    triangles their other edges are, and are told which of these go. Where triangles are many, they are not written, and a
    round counts those of the edges that are left anew.
    """
    from sparkloom.plans.shared import cut

    if k <= 2:
        return cut(edges.select("a", "b"), "truss")
    return packed.numbered(edges.select("a", "b"), lambda e: _truss(e, k), ("a", "b"))


def _truss(edges: DataFrame, k: int) -> DataFrame:
    from sparkloom.plans.shared import cut, discard, release

    order = packed.order_of(edges)
    if order is None:
        return edges
    if k > 3:
        left = _peeled(edges, order, k - 2)
        if left is not None:
            return left
    left, n = None, -1
    while True:
        now = cut(packed.supported(edges if left is None else left, order).where(F.col("triangles") >= k - 2).select("a", "b"), "truss")
        if left is not None:
            discard(left)
        release(edges.sparkSession)
        before, left, n = n, now, now.count()
        if k == 3 or n in (0, before):
            return left


def _peeled(edges: DataFrame, order: packed.Order, least: int) -> DataFrame | None:
    """What is left when edges in fewer than ``least`` triangles go, until none does; None where triangles are too many to write."""
    from sparkloom.plans.shared import cut, discard, release

    spark = edges.sparkSession
    held = cut(packed.peelings(edges, order, least), "peelings")
    release(spark)
    if held.where(F.col("kind") == packed.OVER).limit(1).count():
        discard(held)
        return None
    state = held.where(F.col("kind") < packed.SUMS)
    told, lost = held, []
    while True:
        now = cut(packed.gone(told, order, least), "gone")
        release(spark)
        lost.append(now)
        if not now.limit(1).count():
            break
        state = state.unionByName(now)
        told = packed.peeled(state, order, least, False)
    left = cut(packed.remaining(packed.peeled(state, order, least, True), order), "truss")
    discard(held, *lost)
    release(spark)
    return left


def incidence(edges: DataFrame) -> DataFrame:
    """Triples ``edge, vertex, v`` of edges ``edge, a, b``."""
    return edges.select("edge", F.explode(F.array("a", "b")).alias("vertex")).withColumn("v", F.lit(1.0))


def edges_of_incidence(triples: DataFrame) -> DataFrame:
    """``edge, a, b`` of triples ``edge, vertex, v``."""
    return triples.where("v <> 0").groupBy("edge").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b"))


def truss_of_incidence(triples: DataFrame, k: int) -> DataFrame:
    """The incidence triples whose edges are in the k-truss; parallel edges count as one and stay or go together."""
    edges = edges_of_incidence(triples)
    kept = edges.join(truss(simple_edges(edges), k), ["a", "b"], "left_semi").select("edge")
    return triples.join(kept, "edge", "left_semi")

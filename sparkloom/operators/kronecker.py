"""Exact Kronecker graphs of star factors: generation, and all properties in closed form from the factors alone."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.columns import uniform
from sparkloom.operators.matrix import degree_distribution, kron, unequal

#: Exact whole numbers beyond 64 bits.
WHOLE = T.DecimalType(38, 0)


def bipartite(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Complete bipartite adjacency of ``n`` and ``m`` vertices, 0-based, both directions."""
    left = spark.range(n).select(F.col("id").alias("i"))
    right = spark.range(m).select((F.col("id") + n).alias("j"))
    one = left.crossJoin(right)
    return one.union(one.select("j", "i").toDF("i", "j")).withColumn("v", F.lit(1).cast("long"))


def star(spark: SparkSession, m: int, kind: int = 0) -> DataFrame:
    """A star of ``m`` leaves, centre 0; kind 1 has a loop at the centre, kind 2 at the last leaf."""
    edges = bipartite(spark, 1, m)
    if kind:
        at = 0 if kind == 1 else m
        edges = edges.union(spark.range(1).select(F.lit(at).cast("long").alias("i"), F.lit(at).cast("long").alias("j"), F.lit(1).cast("long").alias("v")))
    return edges


def loop_place(sizes: list[int], kind: int) -> int:
    """Index of the loop that the product of looped stars has."""
    return 0 if kind == 1 else math.prod(m + 1 for m in sizes) - 1


def generate(spark: SparkSession, sizes: list[int], kind: int = 0, parts: int | None = None) -> DataFrame:
    """Adjacency ``i, j, v`` of the product of stars, 0-based, the last loop taken out.

    The largest factors come first, are dealt out, and meet the product of the rest, which is small and broadcast by its size.
    """
    product, n = star(spark, sizes[0], kind), sizes[0] + 1
    if parts:
        product = product.repartition(parts)
    for m in sizes[1:]:
        product = kron(product, star(spark, m, kind).coalesce(1), m + 1)
        n *= m + 1
    if kind:
        at = loop_place(sizes, kind)
        product = product.where(~((F.col("i") == at) & (F.col("j") == at)))
    return product


@dataclass(frozen=True)
class Design:
    """Properties of a product of stars, as exact whole numbers."""

    vertices: int
    nnz: int
    triangles: int
    truss_edges: int | None


def design(sizes: list[int], kind: int = 0) -> Design:
    """Vertices, entries (both directions), triangles, and for kind 2 the edges of the 3-truss; no edge is made."""
    n = len(sizes)
    vertices = math.prod(m + 1 for m in sizes)
    if kind == 0:
        return Design(vertices, math.prod(2 * m for m in sizes), 0, 0)
    nnz = math.prod(2 * m + 1 for m in sizes) - 1
    if kind == 1:
        return Design(vertices, nnz, (math.prod(3 * m + 1 for m in sizes) - 3 * vertices + 2) // 6, None)
    return Design(vertices, nnz, (4**n - 3 * 2**n + 2) // 6, (3**n - 3) // 2)


def factor_degrees(m: int, kind: int) -> dict[int, int]:
    """Degree to number of vertices of one star, a loop counting once."""
    if kind == 0:
        rows = [(m, 1), (1, m)]
    elif kind == 1:
        rows = [(m + 1, 1), (1, m)]
    else:
        rows = [(m, 1), (2, 1), (1, m - 1)]
    found: dict[int, int] = {}
    for d, n in rows:
        if n:
            found[d] = found.get(d, 0) + n
    return found


def design_degrees(sizes: list[int], kind: int = 0) -> dict[int, int]:
    """Degree distribution of the product, the last loop taken out."""
    found = {1: 1}
    for m in sizes:
        larger: dict[int, int] = {}
        for d, n in found.items():
            for e, k in factor_degrees(m, kind).items():
                larger[d * e] = larger.get(d * e, 0) + n * k
        found = larger
    if kind:
        d = math.prod(m + 1 for m in sizes) if kind == 1 else 2 ** len(sizes)
        found[d] -= 1
        found[d - 1] = found.get(d - 1, 0) + 1
    return {d: n for d, n in found.items() if n}


def design_table(spark: SparkSession, sizes: list[int], kind: int = 0) -> DataFrame:
    """``degree, n`` as exact decimals."""
    rows = [(Decimal(d), Decimal(n)) for d, n in sorted(design_degrees(sizes, kind).items())]
    return spark.createDataFrame(rows, T.StructType([T.StructField("degree", WHOLE), T.StructField("n", WHOLE)]))


def check(spark: SparkSession, sizes: list[int], kind: int = 0) -> DataFrame:
    """``property, predicted, measured``: vertices, entries, triangles, edges of the 3-truss, and the vertices of each degree.

    What is predicted comes from the factors alone, what is measured from the generated graph; equal for a right one. The truss
    has no closed form for kind 1, and is not listed there.
    """
    from sparkloom.operators.triangles import simple_edges, triangle_count, truss
    from sparkloom.plans.shared import cut

    graph = cut(generate(spark, sizes, kind), "kronecker")
    edges = simple_edges(graph, "i", "j")
    theory = design(sizes, kind)
    facts = [("vertices", theory.vertices), ("entries", theory.nnz), ("triangles", theory.triangles), ("truss_3_edges", theory.truss_edges)]
    facts += [(f"degree {d}", n) for d, n in design_degrees(sizes, kind).items()]
    schema = T.StructType([T.StructField("property", T.StringType()), T.StructField("predicted", WHOLE)])
    predicted = spark.createDataFrame([(name, Decimal(n)) for name, n in facts if n is not None], schema)
    named = lambda name, rows, value: rows.select(F.lit(name).alias("property"), F.col(value).cast(WHOLE).alias("measured"))
    measured = named("vertices", graph.select(F.explode(F.array("i", "j")).alias("x")).agg(F.count_distinct("x").alias("n")), "n")
    measured = measured.unionByName(named("entries", graph.agg(F.count("*").alias("n")), "n")).unionByName(named("triangles", triangle_count(edges), "triangles"))
    if theory.truss_edges is not None:
        measured = measured.unionByName(named("truss_3_edges", truss(edges, 3).agg(F.count("*").alias("n")), "n"))
    degrees = degree_distribution(graph).select(F.concat(F.lit("degree "), F.col("degree").cast("string")).alias("property"), F.col("n").cast(WHOLE).alias("measured"))
    return predicted.join(measured.unionByName(degrees), "property", "full")


def factors_agree(spark: SparkSession, sizes: list[int], kind: int = 0, split: int = 1) -> DataFrame:
    """Entries in which the product of two parts of the factors and the product of all differ; the last loop counts. Empty if right."""
    left, right = sizes[:split], sizes[split:]
    whole, one, two = (_with_loop(spark, generate(spark, part, kind), part, kind) for part in (sizes, left, right))
    return unequal(whole, kron(one, two, math.prod(m + 1 for m in right)))


def _with_loop(spark: SparkSession, graph: DataFrame, sizes: list[int], kind: int) -> DataFrame:
    if not kind:
        return graph
    at = F.lit(loop_place(sizes, kind)).cast("long")
    return graph.unionByName(spark.range(1).select(at.alias("i"), at.alias("j"), F.lit(1).cast("long").alias("v")))


def windows(sizes: list[int]) -> list[list[int]]:
    """Every prefix and suffix of two or more factors, each once."""
    found = [sizes[:k] for k in range(2, len(sizes) + 1)] + [sizes[k:] for k in range(1, len(sizes) - 1)]
    return [list(x) for x in dict.fromkeys(map(tuple, found))]


def split_design(sizes: list[int], most: int) -> tuple[list[int], list[int]]:
    """Factors dealt to two sides, so that neither side has more than ``most`` entries if that is possible."""
    for k in range(len(sizes) - 1, 0, -1):
        if math.prod(2 * m + 1 for m in sizes[:k]) <= most and math.prod(2 * m + 1 for m in sizes[k:]) <= most:
            return sizes[:k], sizes[k:]
    return sizes[:1], sizes[1:]


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 1) -> DataFrame:
    """R-MAT edges ``src, dst``, 0-based: one draw a bit picks a quadrant, then vertices are renumbered by a seeded bijection.

    The quadrants lie in [0, 1) one after another with widths ``a``, ``b``, ``c`` and the rest; a place in the second or last
    sets the bit of ``dst``, one in the third or last that of ``src``.
    """
    draws = [uniform(seed, bit, F.col("id")) for bit in range(scale)]
    set_bits = lambda hit: sum((F.when(hit(u), 1 << bit).otherwise(0) for bit, u in enumerate(draws)), F.lit(0).cast("long"))
    src = set_bits(lambda u: u >= a + b)
    dst = set_bits(lambda u: (u >= a) & (u < a + b) | (u >= a + b + c))
    rows = spark.range(edge_factor << scale).select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))
    return rows.select(scramble(F.col("src"), scale, seed).alias("src"), scramble(F.col("dst"), scale, seed).alias("dst"))


def scramble(x, bits: int, seed: int):
    """A bijection of the numbers of ``bits`` bits: odd multiplications and xor-shifts modulo a power of two."""
    mask, half = (1 << bits) - 1, max(1, (bits + 1) // 2)
    for k in range(2):
        odd = (40503 * (2 * (seed + k) + 1)) & 0xFFFF | 1
        x = (x * odd + (seed * 7919 + k)).bitwiseAND(F.lit(mask))
        x = x.bitwiseXOR(F.shiftright(x, half))
    return x

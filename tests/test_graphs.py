import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import kronecker, matrix, network, triangles

EDGES = [(1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]


def graph(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def random_graph(n, p, seed):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


def brute_triangles(edges):
    e = set(edges)
    v = sorted({x for p in edges for x in p})
    return {t for t in itertools.combinations(v, 3) if (t[0], t[1]) in e and (t[1], t[2]) in e and (t[0], t[2]) in e}


def test_small_graph(spark):
    g = graph(spark, EDGES)
    t = triangles.triangles(g)
    assert {tuple(r) for r in t.collect()} == {(2, 4, 5), (3, 4, 5)}
    assert {tuple(r) for r in triangles.vertex_degrees(t).collect()} == {(2, 1), (3, 1), (4, 2), (5, 2)}
    assert {tuple(r) for r in triangles.edge_support(g).collect()} == {(1, 5, 0), (2, 4, 1), (2, 5, 1), (3, 4, 1), (3, 5, 1), (4, 5, 2)}
    assert [tuple(r) for r in triangles.k_counts(g).collect()] == [(3, 2)]


def test_formulations_agree(spark):
    edges = random_graph(40, 0.2, 3)
    g = graph(spark, edges)
    both = graph(spark, edges + [(b, a) for a, b in edges]).select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1).cast("long").alias("v"))
    n = len(brute_triangles(edges))
    assert triangles.triangle_count(g).first()[0] == triangles.triangle_count_algebra(both).first()[0] == triangles.triangle_count_lower(both).first()[0] == n
    assert {tuple(r) for r in triangles.triangles(g).collect()} == brute_triangles(edges)


def test_simple_edges_and_empty_graphs(spark):
    g = triangles.simple_edges(graph(spark, [(2, 1), (1, 2), (3, 3), (1, 2)]))
    assert [tuple(r) for r in g.collect()] == [(1, 2)]
    none = graph(spark, []).select("a", "b")
    assert triangles.triangle_count(none).first()[0] == 0
    assert triangles.truss(none, 3).count() == 0


def brute_truss(edges, k):
    now = set(edges)
    while True:
        t = brute_triangles(sorted(now))
        support = {e: 0 for e in now}
        for a, b, c in t:
            for e in ((a, b), (a, c), (b, c)):
                support[e] += 1
        kept = {e for e in now if support[e] >= k - 2}
        if kept == now:
            return now
        now = kept


@pytest.mark.parametrize("k", [3, 4, 5, 6])
def test_truss_is_brute_force(spark, k):
    edges = random_graph(30, 0.3, 8)
    assert {tuple(r) for r in triangles.truss(graph(spark, edges), k).collect()} == brute_truss(edges, k)


def test_truss_of_incidence(spark):
    ends = {1: (1, 2), 2: (2, 3), 3: (1, 4), 4: (3, 4), 5: (1, 3), 6: (2, 5)}
    triples = spark.createDataFrame([(e, v, 1.0) for e, p in ends.items() for v in p], "edge long, vertex long, v double")
    assert {r["edge"] for r in triangles.truss_of_incidence(triples, 3).collect()} == {1, 2, 3, 4, 5}
    assert triangles.truss_of_incidence(triples, 4).count() == 0


def test_truss_of_clique(spark):
    clique = list(itertools.combinations(range(7), 2))
    assert triangles.truss(graph(spark, clique), 7).count() == 21
    assert triangles.truss(graph(spark, clique), 8).count() == 0


KRONECKER = [([3, 4], 0, 20, 48, 0), ([3, 4], 1, 20, 62, 12), ([3, 4], 2, 20, 62, 1), ([3, 4, 5], 0, 120, 480, 0), ([3, 4, 5], 1, 120, 692, 287), ([3, 4, 5], 2, 120, 692, 7)]


@pytest.mark.parametrize("sizes,kind,vertices,nnz,tri", KRONECKER)
def test_kronecker_design_is_what_is_generated(spark, sizes, kind, vertices, nnz, tri):
    d = kronecker.design(sizes, kind)
    assert (d.vertices, d.nnz, d.triangles) == (vertices, nnz, tri)
    a = kronecker.generate(spark, sizes, kind)
    assert a.count() == nnz
    edges = triangles.simple_edges(a.select(F.col("i").alias("a"), F.col("j").alias("b")))
    assert triangles.triangle_count(edges).first()[0] == tri
    if d.truss_edges is not None:
        assert triangles.truss(edges, 3).count() == d.truss_edges
    found = kronecker.check(spark, sizes, kind).collect()
    assert len(found) > 4 and all(r["predicted"] == r["measured"] for r in found)
    assert kronecker.factors_agree(spark, sizes, kind).count() == 0


def test_kronecker_design_beyond_64_bits():
    sizes = [3, 4, 5, 9, 16, 25, 81, 256, 625]
    d = kronecker.design_degrees(sizes, 1)
    assert sum(d.values()) == math.prod(m + 1 for m in sizes)
    assert sum(k * n for k, n in d.items()) == kronecker.design(sizes, 1).nnz
    assert kronecker.windows([3, 4, 5]) == [[3, 4], [3, 4, 5], [4, 5]]


def test_rmat_is_repeatable_and_in_range(spark):
    a, b = (sorted(map(tuple, kronecker.rmat(spark, 6, 4, seed=3).repartition(k).collect())) for k in (1, 5))
    assert a == b and len(a) == 256 and all(0 <= x < 64 for p in a for x in p)
    assert {r[0] for r in spark.range(64).select(kronecker.scramble(F.col("id"), 6, 3)).collect()} == set(range(64))


def test_matrix_operations(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 3), (1, 1, -3)], "i long, j long, v long")
    m = matrix.from_triples(a)
    assert {tuple(r) for r in m.collect()} == {(0, 0, 1), (0, 1, 2)}
    assert {tuple(r) for r in matrix.product(m, m).collect()} == {(0, 0, 1), (0, 1, 2)}
    assert matrix.unequal(m, matrix.transpose(m)).count() == 2
    assert not matrix.has_self_loops(matrix.drop_diagonal(m)) and matrix.has_self_loops(m)
    assert matrix.subtract(m, m).count() == 0
    kron = matrix.kron(m, m, 2)
    assert {tuple(r) for r in kron.collect()} == {(0, 0, 1), (0, 1, 2), (0, 2, 2), (0, 3, 4)}
    p = matrix.permute(spark.createDataFrame([(5, 7, 1), (5, 9, 1), (7, 9, 1)], "i long, j long, v long"))
    assert sorted(tuple(r)[:2] for r in p.collect()) == [(1, 0), (2, 0), (2, 1)]


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    found = {r["id"]: r["place"] for r in matrix.dense_ids(rows, ["id"], "id").collect()}
    assert found == {i: i for i in range(1000)}


def test_network_by_hand(spark):
    y = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 3, 0.2), (3, 1, 100.0)], "row long, neuron long, val double")
    w = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 1, 0.5), (1, 3, 2, 1.0), (1, 1, 3, -1.0), (2, 1, 2, 1.0), (2, 1, 3, 0.1), (2, 2, 1, 5.0)], "layer int, i long, j long, w double")
    one = network.infer(y, w, [-0.3])
    assert {(r[0], r[1], round(r[2], 9)) for r in one.collect()} == {(1, 1, 1.2), (3, 1, 32.0)}
    two = network.infer(y, w, [-0.3, -0.3])
    assert {(r[0], r[1], round(r[2], 9)) for r in two.collect()} == {(1, 2, 0.9), (3, 2, 31.7), (3, 3, 2.9)}
    truth = spark.createDataFrame([(1,), (4,)], "row long")
    assert {tuple(r) for r in network.compare_categories(network.categories(two), truth).collect()} == {(4, "missing"), (3, "unexpected")}


def test_is_sorted(spark):
    rows = spark.range(0, 1000, 1, 5)
    assert matrix.is_sorted(rows, ["id"]) and matrix.is_sorted(rows.limit(0), ["id"])
    assert not matrix.is_sorted(rows.select((-rows["id"]).alias("id")), ["id"])
    assert not matrix.is_sorted(rows.union(spark.range(5)), ["id"])  # in order but from one partition to the next
    assert not matrix.is_sorted(rows.select((rows["id"] % 7).alias("id")), ["id"])


def test_triangles_by_incidence_and_lists(spark):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(140)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    near = {v: {x for p in pairs if v in p for x in p} - {v} for v in range(30)}
    expected = {p: sorted(near[p[0]] & near[p[1]]) for p in pairs if near[p[0]] & near[p[1]]}
    found = {(r["a"], r["b"]): list(r["corners"]) for r in triangles.edges_of_wedges(edges).collect()}
    assert found == expected
    named = edges.selectExpr("a * 100 + b as edge", "a", "b")
    one = F.lit(1.0).alias("v")
    adjacency = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), one).union(edges.select("b", "a", one))
    n = sum(map(len, expected.values())) // 3
    assert triangles.triangle_count_incidence(adjacency, triangles.incidence(named)).first()[0] == n
    for count in (triangles.triangle_count_algebra, triangles.triangle_count_lower):
        assert count(adjacency).first()[0] == n == triangles.triangle_count(edges).first()[0]
    names = edges.select(F.concat(F.lit("n"), F.lpad(F.col("a").cast("string"), 2, "0")).alias("a"), F.concat(F.lit("n"), F.lpad(F.col("b").cast("string"), 2, "0")).alias("b"))
    assert triangles.triangles(names).where("a < b and b < c").distinct().count() == n  # ids may be text

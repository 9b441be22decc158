"""Triangles by packed lists: graphs of many parts, hubs and odd ids against plain Python, and what they move."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import packed, triangles


def moved(spark, run) -> int:
    """Bytes that ``run`` writes to shuffles."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = total()
    run()
    return total() - before


@pytest.fixture
def random_edges(spark):
    """Twenty clusters of 60 vertices, half of whose pairs are edges."""
    rng = random.Random(4)
    pairs = [(60 * c + i, 60 * c + j) for c in range(20) for i in range(60) for j in range(i) if rng.random() < 0.5]
    return spark.createDataFrame([tuple(sorted(p)) for p in pairs], "a long, b long"), len(pairs)


@pytest.fixture
def hubs(monkeypatch):
    """Edges of a graph with hubs, cut into many parts, and its triangles."""
    monkeypatch.setattr(packed, "LEAST", 40)
    monkeypatch.setattr(packed, "MOST", 80)
    rng = random.Random(5)
    pairs = {tuple(sorted((rng.randrange(-40, 80), rng.choice([rng.randrange(-40, 80), -7, 3, 50])))) for _ in range(900)}
    pairs = {(a, b) for a, b in pairs if a != b}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {(a, b, c) for a, b in pairs for c in near[a] & near[b] if b < c}
    return sorted(pairs), found


def sides_of(found):
    sides = {}
    for a, b, c in found:
        for p, x in (((a, b), c), ((a, c), b), ((b, c), a)):
            sides.setdefault(p, []).append(x)
    return {p: sorted(x) for p, x in sides.items()}


def test_codes_come_back():
    rng = np.random.default_rng(1)
    for bits in (1, 8, 31, 63, 64):
        arrays = [rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=bits < 64) if bits < 64 else rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (50, 50)]
        assert all((x == y).all() for x, y in zip(arrays, packed.unpack(packed.pack(*arrays)), strict=True))
    assert [len(x) for x in packed.unpack(packed.pack(np.zeros(0, np.uint64)))] == [0]


def test_k_counts_move_few_bytes(spark, random_edges):
    edges, n = random_edges
    assert moved(spark, lambda: triangles.k_counts(edges).collect()) < 150 * n


def test_triangles_of_many_parts(spark, hubs):
    pairs, found = hubs
    edges = spark.createDataFrame(pairs, "a long, b long")
    order = packed.order_of(edges)
    assert order.parts > 10 and len(order.heavy) > 2
    assert {tuple(r) for r in triangles.triangles(edges).collect()} == found
    assert triangles.triangles(edges).count() == len(found) == triangles.triangle_count(edges).first()[0]
    sides = sides_of(found)
    assert {(r[0], r[1]): r[2] for r in packed.supported(edges).collect()} == {p: len(x) for p, x in sides.items()}


def test_k_counts_of_many_parts(spark, hubs):
    pairs, found = hubs
    sides, corner, expected = sides_of(found), {}, {}
    for t in found:
        for x in t:
            corner[x] = corner.get(x, 0) + 1
    for a, b, c in found:
        side = min(len(sides[p]) for p in ((a, b), (a, c), (b, c))) + 2
        k = min(side, *(int((3 + (1 + 8 * corner[x]) ** 0.5) // 2) for x in (a, b, c)))
        expected[k] = expected.get(k, 0) + 1
    for kind in ("long", "int"):
        edges = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
        assert {r["k"]: r["triangles"] for r in triangles.k_counts(edges).collect()} == expected
    text = edges.select(F.concat(F.lit("v"), "a").alias("x"), F.concat(F.lit("v"), "b").alias("y"))
    assert {r["k"]: r["triangles"] for r in triangles.k_counts(triangles.simple_edges(text, "x", "y")).collect()} == expected


def test_truss_moves_few_bytes(spark, random_edges):
    edges, n = random_edges
    assert moved(spark, lambda: triangles.truss(edges, 3).count()) < 60 * n


def test_truss_of_many_parts(spark, hubs):
    pairs, found = hubs
    left = set(pairs)
    while True:
        sides = sides_of({t for t in found if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= left})
        now = {p for p, x in sides.items() if len(x) >= 3}
        if now == left:
            break
        left = now
    assert {tuple(r) for r in triangles.truss(spark.createDataFrame(pairs, "a long, b long"), 5).collect()} == left


def both_ways(edges):
    one = F.lit(1.0).alias("v")
    return edges.select(F.col("a").alias("i"), F.col("b").alias("j"), one).union(edges.select("b", "a", one))


def test_incidence_count_moves_few_bytes(spark, random_edges):
    edges, n = random_edges
    named = triangles.incidence(edges.selectExpr("a * 10000 + b as edge", "a", "b"))
    assert moved(spark, lambda: triangles.triangle_count_incidence(both_ways(edges), named).collect()) < 150 * n


def test_incidence_count_of_many_parts(spark, hubs):
    pairs, found = hubs
    edges = spark.createDataFrame(pairs, "a long, b long")
    named = triangles.incidence(edges.selectExpr("a * 10000 + b as edge", "a", "b"))
    assert triangles.triangle_count_incidence(both_ways(edges), named).first()[0] == len(found)


def test_edge_corners_move_few_bytes(spark, random_edges):
    edges, n = random_edges
    per_corner = moved(spark, lambda: triangles.edges_of_wedges(edges).count()) / (6 * triangles.triangle_count(edges).first()[0])
    assert per_corner < 12


def test_edge_corners_of_many_parts(spark, hubs):
    pairs, found = hubs
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {(r["a"], r["b"]): list(r["corners"]) for r in triangles.edges_of_wedges(edges).collect()} == sides_of(found)
    text = triangles.simple_edges(edges.select(F.concat(F.lit("v"), "a").alias("x"), F.concat(F.lit("v"), "b").alias("y")), "x", "y")
    names = {(r["a"], r["b"]): list(r["corners"]) for r in triangles.edges_of_wedges(text).collect()}
    assert names == {tuple(sorted((f"v{a}", f"v{b}"))): sorted(f"v{c}" for c in x) for (a, b), x in sides_of(found).items()}


def test_lower_count_moves_few_bytes(spark, random_edges):
    edges, n = random_edges
    assert moved(spark, lambda: triangles.triangle_count_lower(both_ways(edges)).collect()) < 60 * n


def test_algebra_count_moves_few_bytes(spark, random_edges):
    edges, n = random_edges
    assert moved(spark, lambda: triangles.triangle_count_algebra(both_ways(edges)).collect()) < 60 * n


def test_truss_of_several_rounds_moves_few_bytes(spark, random_edges):
    edges, n = random_edges
    assert moved(spark, lambda: triangles.truss(edges, 5).count()) < 120 * n


def peeled_by_hand(pairs, least):
    """The edges left when those in fewer than ``least`` triangles go, round by round, and the number of rounds."""
    left, rounds = set(pairs), 0
    while True:
        near = {}
        for a, b in left:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        now = {(a, b) for a, b in left if len(near[a] & near[b]) >= least}
        if now == left:
            return left, rounds
        left, rounds = now, rounds + 1


def test_truss_of_many_rounds_and_parts(spark, random_edges, monkeypatch):
    monkeypatch.setattr(packed, "LEAST", 8000)
    monkeypatch.setattr(packed, "MOST", 8000)
    edges, n = random_edges
    expected, rounds = peeled_by_hand([tuple(r) for r in edges.collect()], 10)
    assert rounds > 9 and 0 < len(expected) < n
    assert packed.order_of(edges).parts > 4
    found = []
    assert moved(spark, lambda: found.extend(tuple(r) for r in triangles.truss(edges, 12).collect())) < 20 * n
    assert len(found) == len(expected) and set(found) == expected


def test_truss_of_too_many_triangles_to_write(spark, hubs, monkeypatch):
    pairs, _ = hubs
    edges = spark.createDataFrame(pairs, "a long, b long")
    order, expected = packed.order_of(edges), peeled_by_hand(pairs, 3)[0]
    for held in (packed.HELD, -(1 << 20)):
        monkeypatch.setattr(packed, "HELD", held)
        over = packed.peelings(edges, order, 3).where(F.col("kind") == packed.OVER).count()
        assert (over > 0) == (held < 0)
        assert {tuple(r) for r in triangles.truss(edges, 5).collect()} == expected
        assert triangles.truss(edges.limit(1), 5).count() == triangles.truss(edges, 40).count() == 0

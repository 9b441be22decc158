import math
import random

import pytest

from sparkloom.operators.blocks import evaluate, generate, merges, moves, search, state


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def brute_entropy(edges, label):
    m, o, i = {}, {}, {}
    for a, b, w in edges:
        r, c = label[a], label[b]
        m[r, c] = m.get((r, c), 0) + w
        o[r] = o.get(r, 0) + w
        i[c] = i.get(c, 0) + w
    return -sum(map(xlogx, m.values())) + sum(map(xlogx, o.values())) + sum(map(xlogx, i.values()))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    edges = {(a, b): rng.randint(1, 3) for a in range(24) for b in range(24) if rng.random() < (0.4 if a % 3 == b % 3 else 0.1)}
    rows = [(a, b, w) for (a, b), w in edges.items()]  # with loops
    label = {a: rng.choice((a % 3, a % 3, (a + 1) % 3)) for a in range(24)}
    return rows, label, spark.createDataFrame(rows, "src long, dst long, weight long").cache(), spark.createDataFrame(list(label.items()), "node long, block long").cache()


def test_entropy_and_state(small):
    rows, label, edges, labels = small
    m = state.edge_counts(edges, labels)
    assert state.data_entropy(m).first()[0] == pytest.approx(brute_entropy(rows, label), rel=1e-9)
    total = sum(w for *_, w in rows)
    d = state.degrees(m).collect()
    assert sum(r["d_out"] for r in d) == sum(r["d_in"] for r in d) == total == m.agg({"m": "sum"}).first()[0]
    assert sum(r["entropy"] for r in state.row_entropy(m).collect()) == pytest.approx(brute_entropy(rows, label), rel=1e-9)
    assert state.check_state(m, edges, labels).count() == 0
    half = edges.where("src < 12")
    assert state.check_state(state.fold_edges(state.edge_counts(half, labels), edges.where("src >= 12"), labels), edges, labels).count() == 0


def test_merge_deltas(small):
    rows, label, edges, labels = small
    before = brute_entropy(rows, label)
    for r in merges.delta_entropy(state.edge_counts(edges, labels)).collect():
        after = brute_entropy(rows, {n: r["r"] if b == r["s"] else b for n, b in label.items()})
        assert r["delta"] == pytest.approx(after - before, abs=1e-9)


def test_move_deltas_and_hastings(small, spark):
    rows, label, edges, labels = small
    proposed = spark.createDataFrame([(n, b, (b + 1) % 3) for n, b in label.items()], "node long, r long, s long")
    m, around, loops = state.edge_counts(edges, labels), moves.neighbour_blocks(edges, labels), moves.loops_of(edges)
    before = brute_entropy(rows, label)
    found = moves.move_deltas(m, proposed, around, loops).collect()
    assert len(found) == 24
    for r in found:
        assert r["delta"] == pytest.approx(brute_entropy(rows, label | {r["node"]: r["s"]}) - before, abs=1e-9)

    def chance(label, v, s):
        cells, d, k = {}, {}, {}
        for a, b, w in rows:
            cells[label[a], label[b]] = cells.get((label[a], label[b]), 0) + w
            d[label[a]] = d.get(label[a], 0) + w
            d[label[b]] = d.get(label[b], 0) + w
            if a != b and v in (a, b):
                t = label[b if a == v else a]
                k[t] = k.get(t, 0) + w
        return sum(w * (cells.get((t, s), 0) + cells.get((s, t), 0) + 1) / (d[t] + 3) for t, w in k.items())

    for r in moves.hastings(m, proposed, around, loops, 3).collect():
        v = r["node"]
        there, back = chance(label, v, (label[v] + 1) % 3), chance(label | {v: (label[v] + 1) % 3}, v, label[v])
        assert r["ratio"] == pytest.approx(back / there, rel=1e-9)


def test_carry_out(spark):
    labels = spark.createDataFrame([(i, i) for i in range(6)], "node long, block long")
    best = spark.createDataFrame([(0, 1, 0.1), (1, 0, 0.1), (2, 1, 0.2), (3, 4, 0.3), (4, 3, 0.3), (5, 4, 0.9)], "block long, partner long, delta double")
    after = {r["node"]: r["block"] for r in merges.carry_out(labels, best, 3).collect()}
    assert after == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_carry_out_is_brute_force(spark):
    """The cheapest merges that join different blocks, one after another, whatever their number and the length of their rows."""
    rng = random.Random(9)
    for n in (2, 7, 40):
        cost = {(a, b): rng.randint(1, 6) / 4 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3 or b == a + 1}
        best = {}
        for (a, b), c in cost.items():
            for x, y in ((a, b), (b, a)):
                best[x] = min(best.get(x, (9.0, 0)), (c, y))
        rows = spark.createDataFrame([(x, y, c) for x, (c, y) in best.items()], "block long, partner long, delta double")
        labels = spark.createDataFrame([(i, i) for i in range(n)], "node long, block long")
        for most in (1, n // 2, n):
            name, done = list(range(n)), 0
            for c, x, y in sorted((c, x, y) for x, (c, y) in best.items()):
                if done < most and name[x] != name[y]:
                    low, high = sorted((name[x], name[y]))
                    name, done = [low if v == high else v for v in name], done + 1
            assert {r["node"]: r["block"] for r in merges.carry_out(labels, rows, most).collect()} == dict(enumerate(name))


def test_bracket_search_rule():
    b = search.Bracket()
    assert b.next(0.5)[1] == 0
    b.put(search.Point(None, 100.0, 16))
    assert b.next(0.5)[1] == 8
    b.put(search.Point(None, 80.0, 8))
    b.put(search.Point(None, 90.0, 4))
    assert b.closed and [p.blocks for p in b.points] == [16, 8, 4]
    start, n = b.next(0.5)
    assert (start.blocks, n) == (16, 16 - (8 + round(8 * search.GOLDEN)))


def test_evaluation_by_hand(spark):
    of = lambda x: spark.createDataFrame(list(enumerate(x)), "node long, block long")
    m = evaluate.evaluate(of([1, 1, 1, 2, 2, 3]), of([1, 1, 2, 2, 2, 3]))
    expected = {"rand": 0.733333, "adjusted_rand": 0.318182, "pair_recall": 0.5, "pair_precision": 0.5, "pair_f1": 0.5, "h_truth": 1.011404, "h_found": 1.011404, "mutual": 0.693147, "h_truth_given_found": 0.318257, "accuracy": 5 / 6}
    for name, value in expected.items():
        assert m[name] == pytest.approx(value, abs=1e-6), name
    one = evaluate.evaluate(of([1, 1]), of([1, 1]))
    assert one["adjusted_rand"] is None and one["accuracy"] == 1


def test_matching_is_brute_force():
    import itertools

    rng = random.Random(1)
    for n, k in ((3, 3), (3, 5), (5, 5)):
        w = [[rng.randint(0, 9) for _ in range(k)] for _ in range(n)]
        best = max(sum(w[i][p[i]] for i in range(n)) for p in itertools.permutations(range(k), n))
        cells = [(i, j, w[i][j]) for i in range(n) for j in range(k) if w[i][j]]
        assert evaluate.best_matching(cells) == evaluate.best_matching([(j, i, x) for i, j, x in cells]) == best


def test_matching_of_many_blocks(spark):
    """More blocks than any limit there was, in parts that do not touch and one that has them all."""
    n = 5000
    rows = [(f"t{i}", f"f{i}", 5) for i in range(n)] + [(f"t{i}", f"f{i + 1}", 1) for i in range(0, n - 1, 2)]
    table = spark.createDataFrame(rows, "truth string, found string, n long")
    assert evaluate.components_of(table).select("part").distinct().count() == n // 2
    assert evaluate.accuracy(table) == pytest.approx(5 * n / (5 * n + n // 2))
    assert evaluate.accuracy(table.limit(0)) == 0.0
    chain = [(i, i, 3) for i in range(n)] + [(i, i + 1, 2) for i in range(n - 1)]
    assert evaluate.best_matching(chain) == 3 * n


def test_matrix_follows_moves(small, spark):
    rows, label, edges, labels = small
    taken = spark.createDataFrame([(v, (label[v] + 1) % 3) for v in range(0, 24, 2)], "node long, s long")
    after = spark.createDataFrame([(v, (b + 1) % 3 if v % 2 == 0 else b) for v, b in label.items()], "node long, block long")
    m = moves.fold_moves(state.edge_counts(edges, labels), edges, labels, taken)
    assert state.check_state(m, edges, after).count() == 0
    done = moves.sweep(edges, labels, 3, seed=3, turn=0, batches=2)
    assert state.check_state(done.m, edges, done.labels).count() == 0
    names, m, n = state.dense_blocks(labels.withColumn("block", labels["block"] * 10 + 5), state.edge_counts(edges, labels.withColumn("block", labels["block"] * 10 + 5)))
    assert n == 3 and {r["node"]: r["block"] for r in names.collect()} == label and state.check_state(m, edges, names).count() == 0


def test_sampled_pairs_draw_far_blocks(spark):
    ring = [(i, (i + 1) % 40, 1) for i in range(40)]
    m = spark.createDataFrame(ring, "r long, c long, m long")
    pairs = {(r["r"], r["s"]) for r in merges.sampled_pairs(m, 10, 3, 40).collect()}
    apart = [min(b - a, 40 - b + a) for a, b in pairs]
    assert all(0 <= a < b < 40 for a, b in pairs) and max(apart) > 5 and min(apart) <= 2


def test_bracket_helpers():
    b = search.Bracket()
    for blocks, entropy in ((16, 100.0), (8, 80.0), (4, 90.0)):
        b.put(search.Point(None, entropy, blocks))
    least = b.least_by_parabola()
    assert 4 < least < 16 and b.slope() == 2.5
    b.put(search.Point(None, 95.0, 8))
    assert b.best.entropy == 80.0
    b.put(search.Point(None, 70.0, 9))
    b.put(search.Point(None, 99.0, 10))
    assert b.best.blocks == 9 and b.next(0.5)[1] == 0  # neighbours on both sides are known


def test_stages_and_arrival(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (2, 5, 1), (9, 8, 1)], "src long, dst long, weight long")
    depth = {r["node"]: r["depth"] for r in generate.snowball_depth(edges).collect()}
    assert depth == {2: 0, 1: 1, 3: 1, 5: 1, 4: 2}
    path = spark.createDataFrame([(i, i + 1, 1) for i in range(30)], "src long, dst long, weight long")
    assert {r["node"]: r["depth"] for r in generate.snowball_depth(path, start=0).collect()} == {i: i for i in range(31)}
    staged = generate.snowball_stages(edges, 2)
    assert staged.count() == 6 and {r["stage"] for r in staged.collect()} <= {1, 2}
    ids = generate.arrival_ids(staged)
    assert sorted(r["new"] for r in ids.collect()) == list(range(1, 8))
    assert generate.reindex(staged, ids).count() == 6
    assert generate.emerging_stages(edges, 3).count() == 6


def test_planted_graph(spark):
    labels = generate.planted_blocks(spark, 200, 4, seed=2)
    assert {r["block"] for r in labels.collect()} <= {1, 2, 3, 4}
    edges = generate.block_graph(labels, seed=2, within=5.0)
    again = generate.block_graph(labels.repartition(7), seed=2, within=5.0)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, again.collect()))
    wb = generate.within_between(edges, labels).first()
    assert wb["within"] > wb["between"] > 0

import random

import pytest

from sparkloom.operators.blocks import evaluate, local, search, state
from sparkloom.streaming import partition as streaming


def planted(n, blocks, seed, inside=0.35, outside=0.03):
    rng = random.Random(seed)
    label = {v: v % blocks for v in range(n)}
    edges = [(a, b, 1) for a in range(n) for b in range(n) if a != b and rng.random() < (inside if label[a] == label[b] else outside)]
    return edges, label


def brute(edges, label):
    return local.LocalState(local.LocalGraph(edges), label).entropy()


def test_local_deltas():
    edges, label = planted(30, 3, 1)
    edges += [(v, v, 2) for v in range(0, 30, 4)]
    s = local.LocalState(local.LocalGraph(edges), label)
    before = s.entropy()
    for v in range(30):
        r, to = s.label[v], (s.label[v] + 1) % 3
        out, into = s.around(v)
        changes = s.changes(v, r, to, out, into)
        assert s.move_delta(v, to, out, into, changes) == pytest.approx(brute(edges, label | {v: to}) - before, abs=1e-9)
    for r, t in ((0, 1), (0, 2), (1, 2)):
        assert s.merge_delta(r, t) == pytest.approx(brute(edges, {v: r if b == t else b for v, b in label.items()}) - before, abs=1e-9)
    rng = random.Random(2)
    _, gain = s.sweep(rng, 3.0)
    assert s.entropy() == pytest.approx(before + gain, abs=1e-6) and s.entropy() == pytest.approx(brute(edges, s.label), abs=1e-9)


def accepted(truth, frame, found):
    """The entropy is that of the truth or nearly, pairs agree, and the result's entropy is that of its labels."""
    nodes, blocks = truth.count(), truth.select("block").distinct().count()
    best = state.overall_entropy(state.edge_counts(frame, truth), blocks, nodes, float(frame.agg({"weight": "sum"}).first()[0]))
    assert found.entropy <= 1.005 * best
    assert found.entropy == pytest.approx(streaming.entropy_of(frame, found.labels))
    m = evaluate.evaluate(truth, found.labels)
    assert m["pair_precision"] >= 0.9 and m["pair_recall"] >= 0.9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_blocks_are_found(spark, seed):
    edges, label = planted(90, 3, seed)
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    truth = spark.createDataFrame(list(label.items()), "node long, block long")
    accepted(truth, frame, search.partition(frame, seed=seed, local=True))


def test_planted_blocks_are_found_by_the_distributed_search(spark):
    edges, label = planted(36, 2, 4, inside=0.6, outside=0.05)
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    truth = spark.createDataFrame(list(label.items()), "node long, block long")
    found = search.partition(frame, seed=1, rate=0.7, batches=1, most_sweeps=2)
    accepted(truth, frame, found)
    assert state.check_state(found.bracket.best.m, frame, found.labels).count() == 0


def test_distributed_step_and_isolated_nodes(spark):
    edges, label = planted(10, 2, 4, inside=0.9, outside=0.05)
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    truth = spark.createDataFrame([*label.items(), (99, 7)], "node long, block long")
    labels = state.identity_labels(frame, truth)
    start = search.Point(labels, state.overall_entropy(state.edge_counts(frame, labels), 11, 11, float(len(edges))), 11)
    found = search.step(frame, start, 5, 11, float(len(edges)), 5e-4, seed=1, batches=1, most_sweeps=1)
    assert found.labels.count() == 11 and found.blocks <= 6 and found.entropy < start.entropy


def test_pieces_are_folded_in(spark):
    """Two pieces, the second with new nodes: matrices are those of all edges, and the blocks those planted."""
    edges, label = planted(24, 2, 5, inside=0.7, outside=0.05)
    random.Random(1).shuffle(edges)
    first = [e for e in edges if max(e[:2]) < 21][: len(edges) // 2]
    halves = [spark.createDataFrame(part, "src long, dst long, weight long") for part in (first, [e for e in edges if e not in set(first)])]
    whole = spark.createDataFrame(edges, "src long, dst long, weight long")
    truth = spark.createDataFrame([*label.items(), (99, 0)], "node long, block long")
    seen = []
    state_now = streaming.incremental(halves, lambda n, r: seen.append((n, r)), seed=1, batches=1, rate=0.7, most_sweeps=2)
    assert [n for n, _ in seen] == [1, 2]
    for p in state_now.bracket.points:
        assert state.check_state(p.m, whole, p.labels).count() == 0 and p.labels.count() == 24
    found = seen[-1][1]
    assert found.entropy == pytest.approx(streaming.entropy_of(whole, found.labels))
    assert found.entropy <= 1.005 * streaming.entropy_of(whole, truth.where("node < 99"))
    m = streaming.evaluate_observed(truth, found.labels)
    assert m["unseen"] == 1 and m["pair_precision"] >= 0.9 and m["pair_recall"] >= 0.9


def test_naive_stream(spark, tmp_path):
    edges, _ = planted(30, 2, 6, inside=0.5)
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"g_{k}.tsv").write_text("".join(f"{a}\t{b}\t{w}\n" for a, b, w in edges[k::2]))
    seen = []
    stream = streaming.edge_stream(spark, str(source))
    writer = streaming.naive(stream, str(tmp_path / "store"), lambda n, r: seen.append((n, r.blocks)), seed=1, local=True)
    writer.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [0, 1] and seen[-1][1] == 2

import struct

import pytest

from sparkloom.sources import readers, writers


def test_edges_labels_and_pieces(spark, tmp_path):
    (tmp_path / "g_1.tsv").write_text("1\t2\t3\n2\t3\t1\n")
    (tmp_path / "g_2.tsv").write_text("3\t1\n")
    (tmp_path / "l.tsv").write_text("1\t1\n2\t-1\n")
    assert sorted(map(tuple, readers.read_pieces(spark, str(tmp_path / "g")).collect())) == [(1, 2, 3, 1), (2, 3, 1, 1), (3, 1, 1, 2)]
    assert readers.read_graph(spark, str(tmp_path / "g"), parts=1).count() == 2
    assert sorted(map(tuple, readers.read_graph(spark, str(tmp_path / "g_1"), start_idx=1).collect())) == [(0, 1, 3), (1, 2, 1)]
    assert {tuple(r) for r in readers.read_labels(spark, str(tmp_path / "l.tsv")).collect()} == {(1, 1), (2, None)}


def test_triples_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, 2, 0.5), (3, 1, 2.0)], "i long, j long, v double")
    writers.write_triples(a, str(tmp_path / "t"))
    assert {tuple(r) for r in readers.read_triples(spark, str(tmp_path / "t")).collect()} == {(1, 2, 0.5), (3, 1, 2.0)}


@pytest.mark.parametrize("field,symmetry", [("real", "general"), ("integer", "symmetric"), ("pattern", "symmetric")])
def test_matrix_market_round_trip(spark, tmp_path, field, symmetry):
    cells = [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0), (3, 3, 1.0)][:3]
    a = spark.createDataFrame(cells, "i long, j long, v double")
    writers.write_matrix_market(a, str(tmp_path / "m"), 3, 3, field, symmetry, comment=" made for a test")
    assert {tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "m")).collect()} == set(cells)


def test_matrix_market_corner_cases(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 3\n1 1 2\n3 3 3\n2 1 1\n")
    assert {tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "a.mtx")).collect()} == {(1, 1, 2.0), (3, 3, 3.0), (2, 1, 1.0)}
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n0\n4\n")
    assert {tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "b.mtx")).collect()} == {(1, 1, 1.0), (2, 1, 2.0), (2, 2, 4.0)}
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate quaternion general\n1 1 1\n1 1 1 1\n")
    with pytest.raises(ValueError):
        readers.read_matrix_market(spark, str(tmp_path / "c.mtx"))
    (tmp_path / "d.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 3 1\n1 1 1\n")
    with pytest.raises(ValueError):
        readers.read_matrix_market(spark, str(tmp_path / "d.mtx"), square=True)


def test_matrix_market_complex_and_halves(spark, tmp_path):
    def read(text):
        (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix " + text)
        return {(r["i"], r["j"]): tuple(r["v"]) if isinstance(r["v"], tuple) else r["v"] for r in readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()}

    assert read("coordinate complex hermitian\n2 2 2\n1 1 3 0\n2 1 1 4\n") == {(1, 1): (3.0, 0.0), (2, 1): (1.0, 4.0), (1, 2): (1.0, -4.0)}
    assert read("coordinate complex skew-symmetric\n2 2 1\n2 1 1 4\n") == {(2, 1): (1.0, 4.0), (1, 2): (-1.0, -4.0)}
    assert read("coordinate real skew-symmetric\n3 3 1\n3 1 2.5\n") == {(3, 1): 2.5, (1, 3): -2.5}
    assert read("array complex general\n2 1\n1 2\n0 0\n") == {(1, 1): (1.0, 2.0)}
    whole = {(i, j): float(10 * max(i, j) + min(i, j)) for i in range(1, 5) for j in range(1, 5)}
    lower = [f"{10 * i + j}" for j in range(1, 5) for i in range(j, 5)]
    assert read("array real symmetric\n% by columns\n4 4\n" + "\n".join(lower) + "\n") == whole
    strict = [f"{10 * i + j}" for j in range(1, 5) for i in range(j + 1, 5)]
    assert read("array real skew-symmetric\n4 4\n" + "\n".join(strict) + "\n") == {k: v if k[0] > k[1] else -v for k, v in whole.items() if k[0] != k[1]}
    for text in ("array pattern general\n1 1\n1\n", "coordinate real hermitian\n1 1 1\n1 1 1\n"):
        with pytest.raises(ValueError):
            read(text)


def test_binary_edges(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(b"".join(struct.pack("<qq", *p) for p in ((0, 1), (1, 0), (2, 5_000_000_000))))
    rows = readers.read_binary_edges(spark, str(tmp_path / "e.bin"))
    assert sorted(map(tuple, rows.collect())) == [(0, 1), (1, 0), (2, 5_000_000_000)]
    assert readers.adjacency_of_edges(rows).count() == 4


def test_lines_and_categories(spark, tmp_path):
    (tmp_path / "c.txt").write_text("3 5\n8")
    assert sorted(r[0] for r in readers.read_categories(spark, str(tmp_path / "c.txt")).collect()) == [3, 5, 8]
    labels = spark.createDataFrame([(2, 7), (1, 4), (3, 4)], "node long, block long")
    writers.write_labels(labels.coalesce(1), str(tmp_path / "out"))
    (tmp_path / "all.txt").write_text("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))))
    assert sorted(map(tuple, readers.read_label_lines(spark, str(tmp_path / "all.txt")).collect())) == [(1, 4), (2, 7), (3, 4)]

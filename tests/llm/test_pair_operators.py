"""Near-duplicates, vectors and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import near_dups, vectors, words
from sparkloom.llm.components import components


def union(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400 + i) for i in range(1, 60)] + [(5, 5)]
    expected = union(500, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    for most in (1000, 60):  # in one task, and by star steps
        assert {r["id"]: r["component"] for r in components(frame, links_a_task=most).collect()} == {x: expected[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_word_hashes_tell_words_apart():
    texts = [b"", b"Ab ab  aB\tc", b" \n", "é è".encode(), b"a" * 3000 + b" b"]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    lowered = words.LOWER[raw]
    starts, stops, first = words.find(lowered, at, words.NOT_SPACE)
    assert [lowered[a:b].tobytes() for a, b in zip(starts, stops)] == [w for t in texts for w in t.lower().split()]
    h = words.hashes(lowered, starts, stops)
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 6
    assert [len(s) for s in words.shingle_sets(lowered, at, 2)] == [0, 2, 0, 1, 1]


def brute(texts, k):
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, union(len(texts), links)


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "ONE", "one two", "one two"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 9)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts + texts[20:24]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_brute_force(spark, noisy, k):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(noisy)], "doc_id long, text string, digest string").repartition(4)
    sets, expected = brute(noisy, k)
    found = {r["doc_id"]: r for r in near_dups.near_duplicates(docs, k).collect()}
    assert len(found) == len(noisy)
    for i, s in enumerate(sets):
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(s), expected[i], expected[i] == i)
    kept = near_dups.drop_near_duplicates(docs, k)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in enumerate(expected) if c == i}


def test_near_duplicates_corner_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (7, None)], "doc_id long, text string")
    found = near_dups.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None) == [(1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True)]
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]
    # rows with a null or repeated key are documents each, and one of each group stays
    assert sorted(map(tuple, near_dups.drop_near_duplicates(docs).collect())) == [(1, "A b c d e f"), (7, None)]
    only = docs.where("doc_id is null").unionByName(docs.where("doc_id is null"))
    assert [tuple(r) for r in near_dups.drop_near_duplicates(only).collect()] == [(None, "a b c d e f")]
    apart = spark.createDataFrame([(3, "a b c d e f", 0), (3, "some thing else that is said", 1), (3, "", 2)], "doc_id long, text string, number int")
    kept = near_dups.drop_near_duplicates(apart)
    assert kept.columns == apart.columns and kept.count() == 3
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_small_sets_pass_the_signatures(spark):
    """Sets of few shingles at exactly the similarity are likely by their signatures; none of 2,000 pairs is lost."""
    rng = np.random.default_rng(4)
    names = [f"sig{i}" for i in range(near_dups.LONGS)]
    rows = []
    for i in range(4000):
        n = (5, 10, 20)[i % 3]
        pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        shared = n * 4 // 5 if i % 2 else n * 8 // 9
        one, two = (pool[:n], pool[:shared]) if i % 2 else (pool[:n], np.concatenate((pool[:shared], pool[n : 2 * n - shared])))
        similar = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        if similar < 0.8:
            continue
        sides = near_dups.signatures(np.array([near_dups.minima(np.sort(x)) for x in (one, two)])).tolist()
        rows.append(({"n_shingles": len(one)} | dict(zip(names, sides[0], strict=True)), {"n_shingles": len(two)} | dict(zip(names, sides[1], strict=True))))
    kind = "struct<n_shingles: long, " + ", ".join(f"{n}: long" for n in names) + ">"
    frame = spark.createDataFrame(rows, f"x {kind}, y {kind}")
    assert len(rows) >= 2000 and frame.where(near_dups.likely("x", "y", 80)).count() == len(rows)


def test_squares_are_bounded_by_shingles(spark, monkeypatch):
    """A cluster's squares get smaller where its texts are long; the links stay the same."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[: 400 - 4 * i]) for i in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, expected = brute(texts, 5)
    for most in (near_dups.TILE_SHINGLES, 2000, 1):
        monkeypatch.setattr(near_dups, "TILE_SHINGLES", most)
        assert {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs).collect()} == dict(enumerate(expected))


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20_000, rng.integers(0, 3000)).astype(np.uint64)) for _ in range(12)]
    found = near_dups.common_counts(sets[:5], sets[5:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_signatures_estimate_similarity(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    one, two = np.unique(pool[:3000]), np.unique(pool[400:3400])
    packed = near_dups.signatures(np.array([near_dups.minima(one), near_dups.minima(two)])).tolist()
    names = [f"sig{i}" for i in range(near_dups.LONGS)]
    rows = spark.createDataFrame([tuple(packed[0] + packed[1])], [f"x_{n}" for n in names] + [f"y_{n}" for n in names])
    pair = rows.select(F.struct(*[F.col(f"x_{n}").alias(n) for n in names]).alias("x"), F.struct(*[F.col(f"y_{n}").alias(n) for n in names]).alias("y"))
    assert pair.select(near_dups.estimate("x", "y")).first()[0] == pytest.approx(2600 / 3400, abs=0.12)


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(25):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 15))):
            rows.append((base + rng.standard_normal(16) * 0.12).tolist())
    rows += [rows[5], rows[5], [0.0] * 16, [float("nan")] * 16, None, [1.0] * 3, [1.0] * 3, [None] + [1.0] * 15]
    labels = [int(rng.integers(0, 2)) for _ in rows]
    labels[7] = None
    data = [(i, r, labels[i], "x") for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, c string").repartition(3)

    def fine(i):
        r = rows[i]
        return r is not None and labels[i] is not None and None not in r and np.isfinite(r).all() and any(r)

    links = []
    for i in range(len(rows)):
        for j in range(i):
            if fine(i) and fine(j) and labels[i] == labels[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i]), np.array(rows[j])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links.append((i, j))
    expected = union(len(rows), links)
    n = [sum(i in p for p in links) for i in range(len(rows))]
    found = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (n[i], expected[i], expected[i] == i) for i in range(len(rows))}
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_vector_recall_is_measured(spark):
    """Pairs found by the passes alone, on close copies among many others."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 32))
    twin = base + 0.1 * rng.standard_normal(base.shape)
    both = np.vstack([base, twin])
    cosine = (base * twin).sum(1) / np.linalg.norm(base, axis=1) / np.linalg.norm(twin, axis=1)
    linked = int((cosine >= 0.93).sum())
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    found = vectors.near_vectors(frame).where("n_links > 0").count()
    assert linked > 1000 and found >= 2 * 0.99 * linked


def concentrated(n, seed=4):
    """Pairs at a cosine of 0.935 in one label whose mean cosine is 0.7: each pair twice ``n`` rows apart."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    axis = np.zeros(64)
    axis[0] = 0.7**0.5
    side = lambda v: np.hstack([np.zeros((n, 1)), unit(v)])
    one = side(rng.standard_normal((n, 63)))
    other = side(rng.standard_normal((n, 63)))
    other = other - (other * one).sum(1, keepdims=True) * one
    around = (0.935 - 0.7) / 0.3
    two = around * one + (1 - around**2) ** 0.5 * unit(other)
    return np.vstack([axis + 0.3**0.5 * one, axis + 0.3**0.5 * two])


@pytest.mark.parametrize("exact", [vectors.EXACT, 1000])
def test_vectors_of_a_concentrated_label(spark, exact):
    rows = concentrated(6000)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(8)
    passes = None if exact > 12000 else vectors.passes_for(12000, 0.7, 0.93, vectors.WINDOW)
    found = {r["vec_id"]: r["component_id"] for r in vectors.near_vectors(frame, passes=passes, exact=exact).collect()}
    recall = np.mean([found[i] == found[i + 6000] for i in range(6000)])
    assert recall == 1 if exact > 12000 else recall > 0.999


def test_vectors_do_not_depend_on_a_switch_by_size(spark, monkeypatch):
    """Links that no pass finds are found all the same, in labels of any size."""
    rows = concentrated(1500)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    expected = sorted(map(tuple, vectors.near_vectors(frame).collect()))
    passes = vectors.pass_links
    for share in (0, 0.5):
        monkeypatch.setattr(vectors, "pass_links", lambda *a, share=share: passes(*a).where(F.col("a") % 10 < 10 * share))
        assert sorted(map(tuple, vectors.near_vectors(frame, passes=1, exact=500).collect())) == expected
    assert sum(r[1] for r in expected) >= 3000


def test_passes_follow_size_and_spread():
    few, many, close = (vectors.passes_for(n, spread, 0.93, vectors.WINDOW) for n, spread in ((500_000, 0.0), (5_000_000, 0.0), (5_000_000, 0.4)))
    assert 24 < few < many < close

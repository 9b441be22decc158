"""Embedding near-duplicates: sorted projection passes where a label is large, and all pairs of every label.

1. Equal vectors of one label become one class with a count, so copies of any number are one row.
2. Labels of up to ``EXACT`` classes are compared whole, in squares of bounded size: nothing is missed there.
3. A larger label is compared in passes. In a pass a vector, less its label's mean, gets 64 one-bit hashes, the signs of random
   projections, concatenated to a number; the classes are sorted by label and number and dealt into blocks of ``BLOCK``
   positions, each with the last ``WINDOW`` of the block before, so every task compares the same number of rows however the
   numbers crowd. All pairs of a block are compared.
4. The number of passes follows from the label's size and spread, see ``passes_for``; a label goes on beyond it until a round
   of ``ROUND`` passes joins no more of it. Where the passes would cost more than all pairs, there are none. Then all pairs of
   the label that the passes did not join are compared as in 2, so what is found does not depend on how many rows there are.
5. The pairs that reach the cosine are united into components.
6. Inside a component, every pair is compared once, in square blocks of bounded size, for the exact number of links.

The passes leave the check little to give back, but it compares all pairs: its cost grows with the square of a label's classes.
``MISS`` is the chance that a pair at just the cosine meets in no pass, for a label that is isotropic around its mean.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label or id, link with
nothing; vectors of different lengths don't link; repeated rows count as other vectors; ties go to the smallest id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, table
from sparkloom.llm.components import components
from sparkloom.plans.shared import discard

COSINE = 0.93
WINDOW, BLOCK, BITS = 256, 1024, 64
#: Classes of a label up to which all its pairs are compared at once, without passes; passes a round; chance that a pair meets in no pass.
EXACT, ROUND, MISS = 16384, 8, 1e-4
#: Rows on a side of a square that counts links.
TILE = 128


def unit_rows(packed: list[bytes]) -> np.ndarray:
    """Rows of unit length, in double precision."""
    v = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    largest = np.abs(v).max(axis=1, keepdims=True)
    v = v / largest
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def packed_vectors(column: pa.ListArray) -> tuple[list[bytes | None], np.ndarray]:
    """Of each list its numbers as packed doubles, or None where it can't link, and how many they are."""
    sizes = np.diff(column.offsets.to_numpy())
    sizes[np.asarray(column.is_null())] = 0
    values = column.values
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
    some = np.concatenate(([0], np.cumsum(numbers != 0)))
    low = column.offsets.to_numpy()[:-1].astype(np.int64)
    high = low + sizes
    fine = (sizes > 0) & (bad[high] == bad[low]) & (some[high] > some[low])
    raw = numbers.tobytes()
    found = [raw[8 * a : 8 * b] if ok else None for a, b, ok in zip(low.tolist(), high.tolist(), fine.tolist(), strict=True)]
    return found, np.where(fine, sizes, 0)


def prepared(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, dim, vec``: the components as packed doubles; vec is null where the vector can't link."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            packed, dims = packed_vectors(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "label", "dim", "vec"])

    chosen = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return chosen.mapInArrow(run, f"id {kinds[key]}, label {kinds[label]}, dim int, vec binary")


def passes_for(n: int, spread: float, cosine: float, window: int) -> int:
    """Passes that a label of ``n`` classes needs.

    ``spread`` is the label's mean cosine. A pair at ``cosine`` has ``(cosine - spread) / (1 - spread)`` around the mean, which
    gives the chance to agree on a bit; it meets in a pass if it agrees on the bits that leave ``window`` others.
    """
    around = max(-0.999, (cosine - spread) / max(1e-9, 1 - spread))
    meet = (1 - math.acos(min(around, 0.999)) / math.pi) ** max(1.0, math.log2(n / window))
    return math.ceil(math.log(MISS) / math.log1p(-meet))


def label_means(classes: DataFrame) -> DataFrame:
    """``label, dim, mean, n``: the mean of each label's unit vectors, as packed doubles."""
    kind = dict(classes.dtypes)["label"]

    def part(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            for mark, at, vecs in by_mark(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held = sums.setdefault(mark, [0.0, 0])
                held[0] = held[0] + unit_rows(vecs).sum(axis=0)
                held[1] += len(at)
        marks = list(sums)
        for low in range(0, len(marks), 1000):
            some = marks[low : low + 1000]
            names = ["label", "dim", "mean", "n"]
            columns = [[m[0] for m in some], [m[1] for m in some], [sums[m][0].tobytes() for m in some], [sums[m][1] for m in some]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], names)

    def whole(group: pa.Table) -> pa.Table:
        n = sum(group.column("n").to_pylist())
        mean = sum(np.frombuffer(x, np.float64) for x in group.column("mean").to_pylist()) / n
        return pa.table([group.column("label")[:1], group.column("dim")[:1], pa.array([mean.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["label", "dim", "mean", "n"])

    schema = f"label {kind}, dim int, mean binary, n long"
    return classes.select("label", "dim", "vec").mapInArrow(part, schema).groupBy("label", "dim").applyInArrow(whole, schema)


def by_mark(labels: list, dims: list, vecs: list):
    """For each label and dimension of a batch: the two, their places and vectors."""
    places: dict[tuple, list[int]] = {}
    for i, mark in enumerate(zip(labels, dims, strict=True)):
        places.setdefault(mark, []).append(i)
    for mark, at in places.items():
        yield mark, at, [vecs[i] for i in at]


def sort_keys(classes: DataFrame, means: dict[tuple, bytes], turns: range, seed: int) -> DataFrame:
    """A row for each class and pass: ``turn, label, dim, sort_key, id, vec``."""
    kinds = dict(classes.dtypes)
    shared = classes.sparkSession.sparkContext.broadcast(means)

    def run(batches):
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            for mark, at, vecs in by_mark(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                around = unit_rows(vecs) - np.frombuffer(shared.value[mark], np.float64)
                part = batch.take(pa.array(at))
                for turn in turns:
                    planes = np.random.default_rng([seed, mark[1], turn]).standard_normal((mark[1], BITS))
                    keys = ((around @ planes >= 0) * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), turn, np.int32)), pa.array(keys.view(np.int64)), *part.columns], ["turn", "sort_key", "label", "id", "dim", "vec"])

    chosen = classes.select("label", "id", "dim", "vec")
    return chosen.mapInArrow(run, f"turn int, sort_key long, label {kinds['label']}, id {kinds['id']}, dim int, vec binary")


def with_place(ordered: DataFrame) -> DataFrame:
    """Adds each row's partition and its place in it."""
    kinds = ", ".join(f"{n} {k}" for n, k in ordered.dtypes)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
            at += n

    return ordered.mapInArrow(run, f"{kinds}, part int, at long")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix that keep what is connected connected: at most ``n - 1`` of them."""
    left, kept = np.ones(len(linked), bool), []
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            x = todo.pop()
            found = np.flatnonzero(linked[x] & left).tolist()
            left[found] = False
            kept += [(x, y) for y in found]
            todo += found
    return kept


def group_links(group: pa.Table, marks: tuple[str, ...], cosine: float, apart: tuple[str, ...] = ()) -> pa.Table:
    """Links ``a, b`` inside the equal ``marks`` of a group, only those of rows that differ in each column of ``apart``."""
    group = group.sort_by([(m, "ascending") for m in marks]).combine_chunks()
    ids, vecs = group.column("id"), group.column("vec").to_pylist()
    edge = np.zeros(len(vecs) + 1, bool)
    edge[[0, -1]] = True
    for m in marks:
        values = group.column(m).to_numpy()
        edge[1:-1] |= values[1:] != values[:-1]
    edges = np.flatnonzero(edge).tolist()
    sides = [group.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in apart]
    found_a, found_b = [], []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high - low < 2:
            continue
        v = unit_rows(vecs[low:high])
        linked = v @ v.T >= cosine
        np.fill_diagonal(linked, False)
        for side in sides:
            linked &= side[low:high, None] != side[None, low:high]
        for x, y in forest(linked):
            found_a.append(low + x)
            found_b.append(low + y)
    a, b = (ids.take(pa.array(x, pa.int64())) for x in (found_a, found_b))
    return pa.table([a, b], ["a", "b"])


def square_links(classes: DataFrame, cosine: float, known: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` of all pairs of each label, thinned to what keeps the components; small labels share a task.

    ``known`` has ``a, b``, an id and its component so far; links inside one are left out.
    """
    kind = dict(classes.dtypes)["id"]
    joined = ["within"] if known is not None else []
    if known is not None:
        classes = classes.join(known.select(F.col("a").alias("id"), F.col("b").alias("within")), "id", "left").withColumn("within", F.coalesce("within", "id"))
    sizes = materialise(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.count("*").alias("n")), "label_sizes")
    bins = int((sizes.where("parts = 1").agg(F.sum("n")).first()[0] or 0) // BLOCK + 1)
    dealt = classes.select("label", "dim", "id", "c", "vec", *joined).join(sizes.drop("n"), ["label", "dim"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("c", "id"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    mark = F.xxhash64("label", "dim")
    bin_ = F.when(F.col("parts") == 1, F.pmod(mark, F.lit(bins))).otherwise(mark)
    dealt = dealt.select(bin_.alias("bin"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "label", "dim", "id", "vec", *joined)

    def compare(group: pa.Table) -> pa.Table:
        split = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        return group_links(group, ("label", "dim"), cosine, (*(["own"] if split else []), *joined))

    return dealt.repartition("bin", "x", "y").groupBy("bin", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}")


def pass_links(classes: DataFrame, means: dict[tuple, bytes], turns: range, cosine: float, window: int, seed: int) -> DataFrame:
    """Links ``a, b`` found in some passes' blocks, thinned to what keeps the components."""
    spark, kind = classes.sparkSession, dict(classes.dtypes)["id"]
    order = ["turn", "label", "dim", "sort_key", "id"]
    placed = materialise(with_place(sort_keys(classes, means, turns, seed).repartitionByRange(*order).sortWithinPartitions(*order)), "sorted")
    begin, total = [], 0
    for part, n in placed.groupBy("part").count().orderBy("part").toLocalIterator():  # one row a partition
        begin.append((part, total))
        total += n
    starts = spark.createDataFrame(begin, "part int, start long")
    place = placed.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("at"))
    own = F.floor(F.col("place") / BLOCK)
    blocks = F.when(F.col("place") % BLOCK >= BLOCK - window, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = place.select(F.explode(blocks).alias("block"), "turn", "label", "dim", "id", "vec")

    def compare(group: pa.Table) -> pa.Table:
        return group_links(group, ("turn", "label", "dim"), cosine)

    found = materialise(dealt.groupBy("block").applyInArrow(compare, f"a {kind}, b {kind}").distinct(), "pass_links")
    discard(placed)
    return found


def find_links(classes: DataFrame, cosine: float, passes: int | None, window: int, seed: int, exact: int) -> DataFrame:
    """Links ``a, b`` that connect each component: of all pairs, after passes in labels of over ``exact`` classes."""
    spark, kinds = classes.sparkSession, dict(classes.dtypes)
    mark = f"label {kinds['label']}, dim int"
    crowded = classes.groupBy("label", "dim").count().where(F.col("count") > exact).select("label", "dim").collect()
    need, means = {}, {}
    if crowded:  # at most one in ``exact`` rows
        own = classes.join(F.broadcast(spark.createDataFrame(crowded, mark)), ["label", "dim"])
        for r in label_means(own).collect():
            spread = float((np.frombuffer(r["mean"], np.float64) ** 2).sum())
            wanted = passes or passes_for(r["n"], spread, cosine, window)
            if passes or wanted * 2 * BLOCK < r["n"]:  # else all pairs cost no more
                need[r["label"], r["dim"]], means[r["label"], r["dim"]] = wanted, r["mean"]
    if not need:
        return square_links(classes, cosine)
    large = F.broadcast(spark.createDataFrame(list(need), mark))
    links = materialise(square_links(classes.join(large, ["label", "dim"], "left_anti"), cosine), "square_links")
    known = spark.createDataFrame([], links.schema)
    joined: dict[tuple, int] = {}
    turn, active = 0, set(need)
    while active:
        own = classes.join(F.broadcast(spark.createDataFrame(sorted(active, key=str), mark)), ["label", "dim"])
        found = pass_links(own, means, range(turn, turn + ROUND), cosine, window, seed)
        turn += ROUND
        known = materialise(components(known.unionByName(found), "a", "b").select(F.col("id").alias("a"), F.col("component").alias("b")), "known")
        marks = classes.select("label", "dim", F.col("id").alias("a"))
        now = {(r["label"], r["dim"]): r["count"] for r in known.where("a <> b").join(marks, "a").groupBy("label", "dim").count().join(large, ["label", "dim"], "left_semi").collect()}
        active = {m for m in active if turn < need[m] or now.get(m, 0) != joined.get(m, 0)}
        joined = now
    missed = square_links(classes.join(large, ["label", "dim"], "left_semi"), cosine, known)
    return links.unionByName(known).unionByName(missed)


def count_links(members: DataFrame, cosine: float) -> DataFrame:
    """``id, c, links``: for each class of ``members`` the vectors of other classes of its component that it links with."""
    kinds = dict(members.dtypes)
    # written, so that the join reads plain shuffles, which adaptive execution can split
    sizes = materialise(members.groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("parts")), "sizes")
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("c", "id"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "c", "k", "label", "dim", "vec")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, vecs = group.column("own").to_numpy(), group.column("vec").to_pylist()
        marks = np.column_stack([group.column(c).to_numpy() for c in ("label", "dim")])
        links, k = np.zeros(len(own), np.int64), group.column("k").to_numpy()
        split = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        for mark in np.unique(marks, axis=0):
            at = np.flatnonzero((marks == mark).all(axis=1))
            v = unit_rows([vecs[i] for i in at])
            linked = v @ v.T >= cosine
            np.fill_diagonal(linked, False)
            if split:  # pairs of one part are another task's
                linked &= own[at][:, None] != own[at][None]
            links[at] = linked @ k[at]
        return pa.table([group.column("id"), group.column("c"), pa.array(links)], ["id", "c", "links"])

    # dealt by ranges of squares, which hold about as many rows each; a square is never split
    found = dealt.repartitionByRange("component", "x", "y").groupBy("component", "x", "y").applyInArrow(compare, f"id {kinds['id']}, c long, links long")
    return found.groupBy("id", "c").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, seed: int = 11, key: str = "vec_id", vector: str = "embedding", label: str = "label", exact: int = EXACT) -> DataFrame:
    """``key, n_links, component_id, kept`` for each row."""
    ready = prepared(rows, key, vector, label).withColumn("c", F.xxhash64("label", "dim", "vec"))
    ready = materialise(ready, "vectors")
    full = ready.where("vec is not null and label is not null and id is not null")
    classes = materialise(full.groupBy("label", "dim", "c", "vec").agg(F.min("id").alias("id"), F.count("*").alias("k")), "classes")
    linked = components(find_links(classes, cosine, passes, window, seed, exact))
    members = classes.join(linked, "id")
    counted = classes.select("id", "c", "k", "vec", "label").join(linked, "id", "left").join(count_links(members, cosine), ["id", "c"], "left")
    counted = counted.select("c", "vec", "label", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("links"))
    counted = materialise(counted, "counted")
    out = full.select("id", "c", "vec", "label").join(counted, ["c", "vec", "label"]).select("id", "links", "component")
    rest = ready.where("vec is null or label is null or id is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return out.unionByName(rest).select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The same in DuckDB, comparing all pairs of a label; for small tables.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), labels AS (SELECT id, min(other) AS low FROM reach GROUP BY id
), n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, least(t.vec_id, coalesce(l.low, t.vec_id)) AS component_id, t.vec_id <= coalesce(l.low, t.vec_id) AS kept
FROM embeddings t LEFT JOIN labels l ON l.id = t.vec_id LEFT JOIN n ON n.id = t.vec_id
"""

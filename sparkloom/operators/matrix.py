"""Sparse matrices as triples ``i, j, v``: an absent row is a zero, and no two rows share a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.shared import cut


def from_triples(rows: DataFrame) -> DataFrame:
    """Sums repeated places and drops zeros."""
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(*parts: DataFrame) -> DataFrame:
    """Sum of matrices; places that cancel out vanish."""
    whole = parts[0].select("i", "j", "v")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("i", "j", "v"))
    return from_triples(whole)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b.withColumn("v", -F.col("v")))


def symmetrise(a: DataFrame) -> DataFrame:
    """``A + A'``."""
    return add(a, transpose(a))


def lower(a: DataFrame) -> DataFrame:
    return a.where("i > j")


def upper(a: DataFrame) -> DataFrame:
    return a.where("i < j")


def drop_diagonal(a: DataFrame) -> DataFrame:
    return a.where("i <> j")


def has_self_loops(a: DataFrame) -> bool:
    return bool(a.where("i = j and v > 0").limit(1).count())


def binarise(a: DataFrame) -> DataFrame:
    return a.where("v <> 0").select("i", "j", F.lit(1).cast("long").alias("v")).distinct()


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """``A B``: one equi-join on the inner index, multiplied terms being summed before the shuffle."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("v2"))
    terms = a.join(right, a["j"] == right["k"]).select("i", F.col("j2").alias("j"), (F.col("v") * F.col("v2")).alias("v"))
    return terms.groupBy("i", "j").agg(F.sum("v").alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Place by place."""
    right = b.select("i", "j", F.col("v").alias("v2"))
    return a.join(right, ["i", "j"]).select("i", "j", (F.col("v") * F.col("v2")).alias("v"))


def kron(a: DataFrame, b: DataFrame, rows_b: int, columns_b: int | None = None) -> DataFrame:
    """Kronecker product of 0-based matrices. Every pair of entries is an entry of the result, none is compared."""
    columns_b = rows_b if columns_b is None else columns_b
    right = b.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("v").alias("v2"))
    pairs = a.crossJoin(right)
    return pairs.select((F.col("i") * rows_b + F.col("i2")).alias("i"), (F.col("j") * columns_b + F.col("j2")).alias("j"), (F.col("v") * F.col("v2")).alias("v"))


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum("v").alias("v"))


def total(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"), F.count("*").alias("nnz"))


def degree_distribution(a: DataFrame) -> DataFrame:
    """``degree, n``: how many rows have each sum."""
    return row_sums(a).groupBy(F.col("v").alias("degree")).agg(F.count("*").alias("n"))


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where two matrices differ: ``i, j, left, right``, a zero being null."""
    left, right = a.select("i", "j", F.col("v").alias("left")), b.select("i", "j", F.col("v").alias("right"))
    return left.join(right, ["i", "j"], "full").where(~F.col("left").eqNullSafe(F.col("right")))


def decimate(edges: DataFrame, parts: int, part: int) -> DataFrame:
    """Edges ``src, dst, ...`` with both ends congruent to ``part``; ids are divided by ``parts``."""
    kept = edges.where((F.col("src") % parts == part) & (F.col("dst") % parts == part))
    return kept.withColumn("src", F.expr(f"src div {parts}")).withColumn("dst", F.expr(f"dst div {parts}"))


def permute(a: DataFrame, order: Column | None = None) -> DataFrame:
    """Renumbers rows and columns alike, by ascending number of entries; ``order`` replaces that, of column ``id``."""
    counts = a.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("entries"))
    ids = a.select(F.col("i").alias("id")).union(a.select(F.col("j").alias("id"))).distinct().join(counts, "id", "left")
    by = order if order is not None else F.coalesce("entries", F.lit(0))
    placed = dense_ids(ids.withColumn("by", by), ["by", "id"], "id")
    left = placed.select(F.col("id").alias("i"), F.col("place").alias("i2"))
    right = placed.select(F.col("id").alias("j"), F.col("place").alias("j2"))
    return a.join(left, "i").join(right, "j").select(F.col("i2").alias("i"), F.col("j2").alias("j"), "v")


def dense_ids(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """``key, place``: places 0, 1, 2, ... in the order given.

    Only counts of ranges pass through one task: rows are range-partitioned, numbered in their partition, and shifted by
    what the partitions before hold.
    """
    spark = rows.sparkSession
    # the cut fixes which rows are in which partition
    ordered = rows.select(key, *[c for c in order if c != key]).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered, "ordered")
    sizes = [(r["part"], r["count"]) for r in ordered.groupBy("part").count().orderBy("part").collect()]  # one row a partition
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ordered.withColumn("own", own).join(offsets, "part").select(key, (F.col("own") + F.col("start")).alias("place"))


def is_sorted(rows: DataFrame, order: list[str]) -> bool:
    """The rows come in the order of ``order``: inside every partition, and from each to the next.

    Neighbours are compared inside partitions; of each partition only the first and last row go on.
    """
    placed = rows.select(F.struct(*order).alias("k"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("k").over(Window.partitionBy("part").orderBy("at"))
    ends = placed.withColumn("down", before > F.col("k")).groupBy("part").agg(F.max(F.coalesce("down", F.lit(False))).alias("down"), F.min_by("k", "at").alias("first"), F.max_by("k", "at").alias("last"))
    return not ends.withColumn("down", F.col("down") | F.coalesce(F.lag("last").over(Window.orderBy("part")) > F.col("first"), F.lit(False))).where("down").limit(1).count()

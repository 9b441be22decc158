"""Readers of graph and matrix files. Schemas are always given; ids stay as they are in the file unless asked for."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "i long, j long, v double"


def _shift(rows: DataFrame, columns: tuple[str, ...], start_idx: int) -> DataFrame:
    """0-based ids where the file's first is ``start_idx``."""
    for c in columns if start_idx else ():
        rows = rows.withColumn(c, F.col(c) - start_idx)
    return rows


def read_edges(spark: SparkSession, path: str, start_idx: int = 0) -> DataFrame:
    """``src, dst, weight`` of a tab-separated file of two or three columns; a missing weight is 1."""
    rows = spark.read.schema("src long, dst long, weight long").option("sep", "\t").csv(path)
    return _shift(rows.withColumn("weight", F.coalesce("weight", F.lit(1).cast("long"))), ("src", "dst"), start_idx)


def read_labels(spark: SparkSession, path: str, start_idx: int = 0) -> DataFrame:
    """``node, block``; -1 is an unknown block and becomes null."""
    rows = spark.read.schema("node long, block long").option("sep", "\t").csv(path)
    return _shift(rows.withColumn("block", F.when(F.col("block") != -1, F.col("block"))), ("node",), start_idx)


def read_pieces(spark: SparkSession, base: str, parts: int | None = None, start_idx: int = 0) -> DataFrame:
    """``src, dst, weight, piece`` of the files ``<base>_<k>.tsv``, up to piece ``parts``."""
    rows = read_edges(spark, f"{base.removesuffix('.tsv')}_[0-9]*.tsv", start_idx)
    rows = rows.withColumn("piece", F.regexp_extract(F.input_file_name(), r"_(\d+)\.tsv(?:/[^/]*)?$", 1).cast("int"))
    return rows if parts is None else rows.where(F.col("piece") <= parts)


def read_graph(spark: SparkSession, path: str, parts: int = 0, start_idx: int = 0) -> DataFrame:
    """One file, its suffix optional, or the pieces 1 to ``parts``."""
    if parts:
        return read_pieces(spark, path, parts, start_idx).drop("piece")
    return read_edges(spark, path if path.endswith(".tsv") else f"{path}.tsv", start_idx)


def read_triples(spark: SparkSession, path: str, names: tuple[str, str, str] = ("i", "j", "v")) -> DataFrame:
    """A sparse matrix; repeated places are summed."""
    rows = spark.read.schema(TRIPLES).option("sep", "\t").csv(path)
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toDF(*names)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """``row``: a text of numbers, by white space or lines."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"[\s,]+")).alias("w")).where("w <> ''")
    return words.select(F.col("w").cast("double").cast("long").alias("row"))


def read_layers(spark: SparkSession, pattern: str) -> DataFrame:
    """``layer, i, j, w`` of files whose names end in the layer's number, as ``...-l<k>.tsv``."""
    rows = spark.read.schema("i long, j long, w double").option("sep", "\t").csv(pattern)
    return rows.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.tsv(?:/[^/]*)?$", 1).cast("int").alias("layer"), "i", "j", "w")


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("degree decimal(38,0), n decimal(38,0)").option("sep", "\t").csv(path)


def read_factor(spark: SparkSession, path: str, loop: int | None = None) -> DataFrame:
    """A Kronecker factor, 1-based in the file and 0-based here; ``loop`` puts a self-loop back."""
    rows = spark.read.schema("i long, j long, v long").option("sep", "\t").csv(path).select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "v")
    if loop is not None:
        rows = rows.unionByName(spark.range(1).select(F.lit(loop).cast("long").alias("i"), F.lit(loop).cast("long").alias("j"), F.lit(1).cast("long").alias("v")))
    return rows


def _numbered_lines(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """``pos, value``: the lines of a text file numbered from 0, without blank ones and those that begin with ``skip``.

    A line's number needs the counts of all splits before its own, which an RDD gives in the order of the file.
    """
    lines = spark.sparkContext.textFile(path).map(str.strip).filter(lambda x: x and not (skip and x.startswith(skip)))
    return spark.createDataFrame(lines.zipWithIndex().map(lambda x: (x[1], x[0])), "pos long, value string", verifySchema=False)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """``node, block`` of a file of one block a line; the nodes are the lines from 1."""
    return _numbered_lines(spark, path).select((F.col("pos") + 1).alias("node"), F.col("value").cast("long").alias("block"))


def matrix_market_header(spark: SparkSession, path: str) -> tuple[str, str, str, list[int]]:
    """Layout, field and symmetry of the banner, and the numbers of the size line."""
    lines = spark.read.text(path)
    banner = lines.first()
    words = (banner[0] if banner else "").lower().split()
    if len(words) != 5 or words[0] != "%%matrixmarket" or words[1] != "matrix":
        raise ValueError("not a Matrix Market file: no banner")
    layout, field, symmetry = words[2:]
    if layout not in ("coordinate", "array") or field not in ("real", "integer", "pattern", "complex") or symmetry not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"a Matrix Market kind that is not read: {' '.join(words[2:])}")
    if field == "pattern" and (layout == "array" or symmetry == "skew-symmetric"):
        raise ValueError("an array has values, and so has what changes its sign")
    if symmetry == "hermitian" and field != "complex":
        raise ValueError("only complex matrices are Hermitian")
    size = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    if size is None:
        raise ValueError("no size line")
    return layout, field, symmetry, [int(x) for x in size[0].split()]


def read_matrix_market(spark: SparkSession, path: str, square: bool = False) -> DataFrame:
    """``i, j, v``, 1-based; the half that a symmetric file leaves out is filled in, a pattern's entries are 1.

    The values of a complex matrix are structs ``re, im``; the other half of a Hermitian one is conjugate.
    """
    layout, field, symmetry, size = matrix_market_header(spark, path)
    if square and size[0] != size[1]:
        raise ValueError(f"not square: {size[0]} by {size[1]}")
    words = F.split(F.trim("value"), r"\s+")

    def value(first: int) -> Column:
        part = lambda k: F.col("w")[first + k].cast("double")
        return F.lit(1.0) if field == "pattern" else F.struct(part(0).alias("re"), part(1).alias("im")) if field == "complex" else part(0)

    if layout == "array":
        entries = _numbered_lines(spark, path, "%").where("pos > 0").select(F.col("pos") - 1, words.alias("w")).toDF("at", "w")
        place = (F.col("at") % size[0] + 1).cast("long"), F.expr(f"at div {size[0]} + 1").cast("long")
        if symmetry != "general":  # the lower half by columns, without the diagonal where signs change
            place = _lower_place(F.col("at"), size[0], symmetry == "skew-symmetric")
        zero = F.col("v.re").eqNullSafe(0.0) & F.col("v.im").eqNullSafe(0.0) if field == "complex" else F.col("v") == 0
        rows = entries.select(place[0].alias("i"), place[1].alias("j"), value(0).alias("v")).where(~zero)
    else:
        body = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
        rows = body.select(words.alias("w")).select(F.col("w")[0].cast("long").alias("i"), F.col("w")[1].cast("long").alias("j"), value(2).alias("v"), F.size("w").alias("k"))
        # the size line has three numbers, as an entry may have; it is told by its own
        least = {"pattern": 2, "complex": 4}.get(field, 3)
        first = F.col("k") == 3 if least != 3 else (F.col("i") == size[0]) & (F.col("j") == size[1]) & (F.col("v") == float(size[2]))
        headed = rows.where(first).count()
        again = rows.where(first).limit(headed - 1) if headed > 1 else None  # entries that look like the size line
        rows = rows.where(~first)
        rows = (rows if again is None else rows.unionByName(again)).drop("k")
    if symmetry != "general":
        v = F.col("v")
        if field == "complex":
            re, im = {"symmetric": (1, 1), "skew-symmetric": (-1, -1), "hermitian": (1, -1)}[symmetry]
            v = F.struct((F.col("v.re") * re).alias("re"), (F.col("v.im") * im).alias("im"))
        elif symmetry == "skew-symmetric":
            v = -v
        rows = rows.unionByName(rows.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), v.alias("v")))
    return rows


def _lower_place(at: Column, n: int, strict: bool) -> tuple[Column, Column]:
    """Row and column, from 1, of the ``at``-th entry of a lower triangle by columns."""
    m = n - 1 if strict else n  # entries in the first column
    behind = F.lit(m * (m + 1) // 2 - 1) - at  # entries after this one
    back = F.floor((F.sqrt(8.0 * behind + 1) - 1) / 2).cast("long")  # columns after its own
    column = m - back
    row = n - (behind - (back * (back + 1) / 2).cast("long"))
    return row.cast("long"), column.cast("long")


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """``v0, v1``: pairs of little-endian 64-bit integers; records are read in splits, however large the file, and turned to
    numbers many at a time."""
    records = spark.sparkContext.binaryRecords(path, 16)

    def numbers(split):
        while chunk := list(itertools.islice(split, 1 << 15)):
            yield from map(tuple, np.frombuffer(b"".join(map(bytes, chunk)), "<i8").reshape(-1, 2).tolist())

    return spark.createDataFrame(records.mapPartitions(numbers), "v0 long, v1 long", verifySchema=False)


def adjacency_of_edges(edges: DataFrame, a: str = "v0", b: str = "v1", both: bool = True) -> DataFrame:
    """``i, j, v``: distinct places with value 1, both directions unless told otherwise."""
    rows = edges.select(F.col(a).alias("i"), F.col(b).alias("j"))
    if both:
        rows = rows.union(rows.select("j", "i"))
    return rows.distinct().withColumn("v", F.lit(1).cast("long"))

"""Writers of graph and matrix files. Folders of part files; where the format needs one file, one task writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_triples(a: DataFrame, path: str) -> None:
    """``i, j, v`` by tabs, a file a task."""
    a.select(*a.columns[:3]).write.option("sep", "\t").csv(path)


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.select(*rows.columns[:2]).write.option("sep", "\t").csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).write.text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Blocks one a line in the order of nodes; part files in order make the whole."""
    labels.orderBy("node").select(F.col("block").cast("string")).write.text(path)


def write_distribution(rows: DataFrame, path: str) -> None:
    rows.select("degree", "n").orderBy("degree").write.option("sep", "\t").csv(path)


def write_stages(edges: DataFrame, path: str) -> None:
    """A folder for each stage."""
    edges.write.partitionBy("stage").option("sep", "\t").csv(path)


def write_pieces(edges: DataFrame, base: str, parts: int) -> None:
    """The pieces 1 to ``parts`` of edges with a column ``piece`` as ``<base>_<k>.tsv``, each a folder of part files."""
    for k in range(1, parts + 1):
        edges.where(F.col("piece") == k).select("src", "dst", "weight").write.option("sep", "\t").csv(f"{base}_{k}.tsv")


def write_layers(weights: DataFrame, base: str) -> None:
    """``layer, i, j, w`` as ``<base>/n-l<k>.tsv``, a folder of part files a layer."""
    for (k,) in weights.select("layer").distinct().orderBy("layer").toLocalIterator():
        weights.where(F.col("layer") == k).select("i", "j", "w").write.option("sep", "\t").csv(f"{base}/n-l{k}.tsv")


def write_generated(edges: DataFrame, labels: DataFrame, base: str) -> None:
    """A generated graph, its truth and, where edges have a ``stage``, its stages, all tab-separated."""
    write_triples(edges.select("src", "dst", "weight"), f"{base}.tsv")
    write_pairs(labels.orderBy("node"), f"{base}_truePartition.tsv")
    if "stage" in edges.columns:
        write_stages(edges, f"{base}_stages")


def write_kronecker(spark: SparkSession, sizes: list[int], base: str) -> None:
    """For each kind of star its product as triples from 1, its degree distribution, and the one that theory gives."""
    from sparkloom.operators import kronecker
    from sparkloom.operators.matrix import degree_distribution

    for kind in range(3):
        graph = kronecker.generate(spark, sizes, kind)
        write_triples(graph.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v"), f"{base}_{kind}.tsv")
        write_distribution(degree_distribution(graph), f"{base}_{kind}_degrees.tsv")
        write_distribution(kronecker.design_table(spark, sizes, kind), f"{base}_{kind}_theory.tsv")


def write_matrix_market(a: DataFrame, path: str, rows: int, columns: int, field: str = "real", symmetry: str = "general", comment: str = "") -> None:
    """One text file; of a symmetric matrix the lower half is written. One task writes it, as the format is one stream."""
    own = a.where("i >= j") if symmetry != "general" else a
    n = own.count()
    value = [] if field == "pattern" else [F.col("v").cast("long" if field == "integer" else "double").cast("string")]
    body = own.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), *value).alias("value"), F.lit(1).alias("part"), "i", "j")
    head = [f"%%MatrixMarket matrix coordinate {field} {symmetry}", *(f"%{x}" for x in comment.splitlines()), f"{rows} {columns} {n}"]
    top = a.sparkSession.createDataFrame([(x, 0, k, 0) for k, x in enumerate(head)], "value string, part int, i long, j long")
    top.unionByName(body).coalesce(1).sortWithinPartitions("part", "i", "j").select("value").write.text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Benchmark rows with a header."""
    rows.write.option("header", True).csv(path)


def show_triangles(found: DataFrame, n: int = 20) -> None:
    found.orderBy("a", "b", "c").show(n)


def show_k_counts(counts: DataFrame, n: int = 100) -> None:
    counts.orderBy("k").show(n)

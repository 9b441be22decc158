"""Queries over the star-schema tables: each builds its graph or matrix from whole tables and applies one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import xlogx
from sparkloom.operators import kronecker, matrix, network, triangles
from sparkloom.operators.blocks import evaluate, generate, merges, moves, search, state
from sparkloom.plans.shared import cut, discard, new_path, release
from sparkloom.sources import readers, writers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- graphs of the tables


def co_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a < b, w``: parts ordered together, and in how many orders."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    pairs = items.select("o", F.col("p").alias("a")).join(items.select("o", F.col("p").alias("b")), "o").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("w"))


def co_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without weights, written once, as every query reads it several times; in ranges, which pack well."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).where("o is not null and p is not null")
    baskets = cut(items.repartition("o").groupBy("o").agg(F.sort_array(F.collect_set("p")).alias("parts")).where(F.size("parts") > 1).select("parts"), "baskets")
    release(spark)
    firsts = baskets.select(F.posexplode("parts").alias("at", "a"), "parts")
    pairs = firsts.select("a", F.explode(F.slice("parts", F.col("at") + 2, F.size("parts"))).alias("b"))
    edges = cut(pairs.repartitionByRange("a", "b").distinct(), "co_parts")
    discard(baskets)
    del items, baskets, firsts, pairs
    release(spark)
    return edges


def co_part_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric 0-1 triples."""
    return symmetric(co_part_edges(spark, sf_dir))


def symmetric(e: DataFrame) -> DataFrame:
    """0-1 triples of edges ``a, b``, both directions."""
    one = F.lit(1).cast("long").alias("v")
    return e.select(F.col("a").alias("i"), F.col("b").alias("j"), one).unionByName(e.select(F.col("b").alias("i"), F.col("a").alias("j"), one))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, weight``: customers (even ids) to suppliers (odd ids), and how many items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.sum("n").alias("weight"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, block``: the nations of customers and suppliers."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").cast("long").alias("block"))
    return c.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node"), F.col("s_nationkey").cast("long").alias("block")))


def nation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.edge_counts(sales(spark, sf_dir), nations(spark, sf_dir))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_matrix(spark, sf_dir).select(F.col("r").alias("src"), F.col("c").alias("dst"), F.col("m").alias("weight"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row, neuron, val`` of the embeddings; neurons from 0."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("neuron", "val"))
    return e.select("row", F.col("neuron").cast("long").alias("neuron"), F.col("val").cast("double").alias("val")).where("val <> 0")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``layer, i, j, w``: three layers of 64 neurons, by return flag; weights are mean discounts of parts and suppliers, centred."""
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = table(spark, sf_dir, "lineitem").groupBy(flag.alias("layer"), (F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j")).agg(F.avg(F.col("l_discount") - 0.05).alias("w"))
    return rows.select("layer", "i", "j", F.round(F.col("w") * 20, 6).alias("w"))


# ---- queries


def edge_list(spark, d):
    return sales(spark, d)


def symmetrize(spark, d):
    m = nation_matrix(spark, d).toDF("i", "j", "v")
    return matrix.symmetrise(m)


def transpose(spark, d):
    return matrix.transpose(sales(spark, d).toDF("i", "j", "v"))


def lower_triangle(spark, d):
    return matrix.lower(nation_matrix(spark, d).toDF("i", "j", "v"))


def upper_triangle(spark, d):
    return matrix.upper(nation_matrix(spark, d).toDF("i", "j", "v"))


def drop_diagonal(spark, d):
    return matrix.drop_diagonal(nation_matrix(spark, d).toDF("i", "j", "v"))


def binarise(spark, d):
    return matrix.binarise(sales(spark, d).toDF("i", "j", "v"))


def degree(spark, d):
    return matrix.row_sums(co_part_matrix(spark, d))


def column_sums(spark, d):
    return matrix.column_sums(sales(spark, d).toDF("i", "j", "v"))


def degree_distribution(spark, d):
    return matrix.degree_distribution(co_part_matrix(spark, d))


def matrix_totals(spark, d):
    return matrix.total(sales(spark, d).toDF("i", "j", "v"))


def spgemm(spark, d):
    s = sales(spark, d).toDF("i", "j", "v")
    back = matrix.transpose(s)
    return matrix.product(back, s)


def hadamard(spark, d):
    m = nation_matrix(spark, d).toDF("i", "j", "v")
    return matrix.hadamard(m, matrix.transpose(m))


def sparse_add(spark, d):
    m = nation_matrix(spark, d).toDF("i", "j", "v")
    return matrix.subtract(m, matrix.transpose(m))


def matrix_unequal(spark, d):
    m = nation_matrix(spark, d).toDF("i", "j", "v")
    return matrix.unequal(m, matrix.transpose(m))


def kron_product(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"), F.lit(1).cast("long").alias("v"))
    return matrix.kron(nation, nation, 25, 5)


def kron_generate(spark, d):
    return kronecker.generate(spark, [3, 4, 5], 2)


def kron_degree_distribution(spark, d):
    return matrix.degree_distribution(kronecker.generate(spark, [3, 4, 5], 1))


def kron_check(spark, d):
    return kronecker.check(spark, [3, 4, 5], 2)


def decimate(spark, d):
    return matrix.decimate(co_parts(spark, d).toDF("src", "dst", "weight"), 4, 1)


def triangle_count(spark, d):
    return triangles.triangle_count(co_part_edges(spark, d))


def triangle_count_algebra(spark, d):
    return triangles.triangle_count_algebra(co_part_matrix(spark, d))


def triangle_count_lower(spark, d):
    return triangles.triangle_count_lower(co_part_matrix(spark, d))


def triangle_enumerate(spark, d):
    return triangles.triangles(co_part_edges(spark, d))


def triangle_vertex_degree(spark, d):
    return triangles.vertex_degrees(triangles.triangles(co_part_edges(spark, d)))


def triangle_edge_degree(spark, d):
    return triangles.edge_degrees(triangles.triangles(co_part_edges(spark, d)))


def edge_support(spark, d):
    return triangles.edge_support(co_part_edges(spark, d))


def k_counts(spark, d):
    return triangles.k_counts(co_part_edges(spark, d))


def ktruss_3(spark, d):
    return triangles.truss(co_part_edges(spark, d), 3)


def ktruss_5(spark, d):
    return triangles.truss(co_part_edges(spark, d), 5)


def dnn_layer(spark, d):
    w = weights(spark, d).where("layer = 1").select("i", "j", "w")
    return network.layer(features(spark, d), w, -0.01).select("row", "neuron", F.round("val", 6).alias("val"))


def dnn_infer_3(spark, d):
    return network.infer(features(spark, d), weights(spark, d), [-0.01] * 3).select("row", "neuron", F.round("val", 5).alias("val"))


def dnn_categories(spark, d):
    return network.categories(network.infer(features(spark, d), weights(spark, d), [-0.01] * 3))


def block_edge_counts(spark, d):
    return nation_matrix(spark, d)


def block_degrees(spark, d):
    return state.degrees(nation_matrix(spark, d))


def data_entropy(spark, d):
    return state.data_entropy(nation_matrix(spark, d)).select(F.round("entropy", 4).alias("entropy"))


def row_entropy(spark, d):
    return state.row_entropy(nation_matrix(spark, d)).select("r", F.round("entropy", 4).alias("entropy"))


def overall_entropy(spark, d):
    """Data and model entropy as columns, so that one job gives all."""
    m = nation_matrix(spark, d)
    counts = m.agg(F.sum("m").alias("e")).crossJoin(state.degrees(m).agg(F.count("*").alias("b"))).crossJoin(nations(spark, d).agg(F.count("*").alias("n")))
    x = F.col("b") * F.col("b") / F.col("e")
    model = F.col("e") * (xlogx(1 + x) - xlogx(x)) + F.col("n") * F.ln("b")
    both = state.data_entropy(m).crossJoin(counts)
    return both.select(F.round(model, 4).alias("model"), F.round("entropy", 4).alias("data"), F.round(model + F.col("entropy"), 4).alias("overall"))


def merge_delta_entropy(spark, d):
    return merges.delta_entropy(nation_matrix(spark, d)).select("r", "s", F.round("delta", 4).alias("delta"))


def best_merge(spark, d):
    return merges.best_merges(merges.delta_entropy(nation_matrix(spark, d))).select("block", "partner", F.round("delta", 4).alias("delta"))


def supplier_moves(spark, d):
    """``node, r, s``: each supplier to the next nation."""
    nation = F.col("s_nationkey").cast("long")
    return table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node"), nation.alias("r"), ((nation + 1) % 25).alias("s"))


def move_delta_entropy(spark, d):
    """What it costs to move each supplier to the next nation."""
    edges, labels = sales(spark, d), nations(spark, d)
    proposed = supplier_moves(spark, d)
    around = moves.neighbour_blocks(edges, labels)
    return moves.move_deltas(state.edge_counts(edges, labels), proposed, around, moves.loops_of(edges)).select("node", "r", "s", F.round("delta", 4).alias("delta"))


def hastings_ratio(spark, d):
    edges, labels = sales(spark, d), nations(spark, d)
    proposed = supplier_moves(spark, d)
    around = moves.neighbour_blocks(edges, labels)
    return moves.hastings(state.edge_counts(edges, labels), proposed, around, moves.loops_of(edges), 25).select("node", F.round("ratio", 6).alias("ratio"))


def neighbour_blocks(spark, d):
    return moves.neighbour_blocks(sales(spark, d), nations(spark, d))


def _segments(spark, d):
    c = table(spark, d, "customer")
    truth = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("string").alias("block"))
    return truth, c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("block"))


def contingency(spark, d):
    return evaluate.contingency(*_segments(spark, d))


def pair_metrics(spark, d):
    m = evaluate.pair_metrics(evaluate.contingency(*_segments(spark, d)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def information_metrics(spark, d):
    m = evaluate.information_metrics(evaluate.contingency(*_segments(spark, d)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def matching_accuracy(spark, d):
    value = evaluate.accuracy(evaluate.contingency(*_segments(spark, d)))
    return spark.range(1).select(F.lit(value).alias("accuracy"))


def snowball_depth(spark, d):
    return generate.snowball_depth(co_parts(spark, d).toDF("src", "dst", "weight"))


def snowball_stages(spark, d):
    return generate.snowball_stages(co_parts(spark, d).toDF("src", "dst", "weight"), 4).select("src", "dst", "stage")


def emerging_stages(spark, d):
    return generate.emerging_stages(sales(spark, d), 10)


def arrival_ids(spark, d):
    """Users of the event stream numbered by the month they first appear in, then by id; event types are the other ends."""
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("user_id").alias("dst"), F.month("ts").alias("stage"))
    return generate.arrival_ids(e)


def stream_block_counts(spark, d):
    """The block matrix of the sales fed as a stream of the whole table, all edges so far."""
    from sparkloom.streaming.partition import running_counts

    edges = cut(sales(spark, d), "stream")
    folder = edges.inputFiles()[0].rsplit("/", 1)[0]
    out = new_path(spark, "counts")
    stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    writer = running_counts(stream, nations(spark, d)).writeStream.outputMode("complete").option("checkpointLocation", f"{out}-log")
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("r long, c long, m long").parquet(out)


def sbp_sweep(spark, d):
    """One sweep over all customers and suppliers, from their nations as blocks."""
    return moves.sweep(cut(sales(spark, d), "edges"), cut(nations(spark, d), "labels"), 25, seed=1, turn=0, batches=2).labels


def sbp_partition(spark, d):
    """The distributed search on all sales, resumed from the nations as blocks: it merges and settles until the bracket is done."""
    edges, labels = cut(sales(spark, d), "edges"), cut(nations(spark, d), "labels")
    nodes = state.nodes_of(edges)
    labels, m, blocks = state.dense_blocks(labels.join(nodes, "node", "left_semi"), None)
    m = cut(state.edge_counts(edges, labels), "matrix")
    n_edges = float(edges.agg(F.sum("weight")).first()[0])
    start = search.Bracket()
    start.put(search.Point(labels, state.overall_entropy(m, blocks, labels.count(), n_edges), blocks, m))
    return search.partition(edges, seed=1, resume=start, batches=1, most_sweeps=1).labels


def sbm_generate(spark, d):
    """A planted graph on the customers, their nations as blocks."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") + 1).cast("long").alias("block"))
    return generate.block_graph(c, seed=1)


def rmat_generate(spark, d):
    return kronecker.rmat(spark, 10, 8, seed=1)


def triangle_count_incidence(spark, d):
    e = co_part_edges(spark, d).withColumn("edge", F.concat_ws("-", "a", "b"))
    return triangles.triangle_count_incidence(symmetric(e), triangles.incidence(e))


def edge_corners(spark, d):
    """Of each edge in a triangle the corners opposite, as one text."""
    found = triangles.edges_of_wedges(co_part_edges(spark, d))
    return found.select("a", "b", F.array_join(F.transform("corners", lambda x: x.cast("string")), ",").alias("corners"))


# ---- files: written to the shared folder, and read again


def file_edges(spark, d):
    path = new_path(spark, "edges")
    writers.write_triples(sales(spark, d), path)
    return readers.read_edges(spark, path)


def file_edges_from_one(spark, d):
    """Ids from 1 in the file, from 0 in the table; the weight is left out and read as 1."""
    path = new_path(spark, "pairs")
    writers.write_pairs(sales(spark, d), path)
    return readers.read_edges(spark, path, start_idx=1)


def file_labels(spark, d):
    path = new_path(spark, "labels")
    writers.write_pairs(nations(spark, d).select("node", F.when(F.col("block") == 7, -1).otherwise(F.col("block")).alias("block")), path)
    return readers.read_labels(spark, path)


def file_label_lines(spark, d):
    """Blocks one a line in the order of nodes, read as one stream of lines."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("block"))
    path = new_path(spark, "lines")
    writers.write_labels(c.coalesce(1), path)
    return readers.read_label_lines(spark, path)


def file_pieces(spark, d):
    """Sales dealt to three pieces, each a file that the name numbers; the first two are read."""
    base = new_path(spark, "piece")
    writers.write_pieces(sales(spark, d).withColumn("piece", (F.col("src") % 3 + 1).cast("int")), base, 3)
    return readers.read_pieces(spark, base, parts=2)


def file_triples(spark, d):
    path = new_path(spark, "triples")
    writers.write_triples(nation_matrix(spark, d).toDF("i", "j", "v"), path)
    return readers.read_triples(spark, path)


def file_matrix_market(spark, d):
    path = new_path(spark, "market")
    writers.write_matrix_market(nation_matrix(spark, d).select((F.col("r") + 1).alias("i"), (F.col("c") + 1).alias("j"), F.col("m").alias("v")), path, 25, 25, "integer")
    return readers.read_matrix_market(spark, path, square=True)


def file_matrix_market_symmetric(spark, d):
    """The lower half is written, and read to both halves."""
    path = new_path(spark, "market")
    writers.write_matrix_market(symmetrize(spark, d).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v"), path, 25, 25, "real", "symmetric", comment="both ways")
    return readers.read_matrix_market(spark, path)


def file_layers(spark, d):
    base = new_path(spark, "layers")
    writers.write_layers(weights(spark, d), base)
    return readers.read_layers(spark, f"{base}/*.tsv")


def file_categories(spark, d):
    path = new_path(spark, "categories")
    writers.write_lines(table(spark, d, "supplier").select(F.col("s_nationkey").alias("n")), "n", path)
    return readers.read_categories(spark, path)


def file_distribution(spark, d):
    path = new_path(spark, "distribution")
    writers.write_distribution(degree_distribution(spark, d), path)
    return readers.read_distribution(spark, path)


def file_factor(spark, d):
    """A star in a file from 1, read from 0 with its loop put back."""
    path = new_path(spark, "factor")
    writers.write_triples(kronecker.star(spark, 5).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v"), path)
    return readers.read_factor(spark, path, loop=5)


def file_stages(spark, d):
    """Edges by month of order, a folder a stage, and counted by what the folders say."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("stage"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    edges = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), "stage")
    path = new_path(spark, "stages")
    writers.write_stages(edges, path)
    return spark.read.option("sep", "\t").schema("src long, dst long, stage int").csv(path).groupBy("stage").agg(F.count("*").alias("edges"), F.sum("src").alias("src"))


def run_statistics(spark, d):
    """Mean and spread of order prices by status and priority, as of repeated runs."""
    return evaluate.run_statistics(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").select("o_orderstatus", "o_orderpriority", "runs", F.round("mean", 3).alias("mean"), F.round("spread", 3).alias("spread"))


def round_robin(spark, d):
    return moves.round_robin(nations(spark, d))


def stride_order(spark, d):
    return moves.stride_order(nations(spark, d).select("node"), 7)


QUERIES = {f.__name__: f for f in (
    edge_list, symmetrize, transpose, lower_triangle, upper_triangle, drop_diagonal, binarise, degree, column_sums, degree_distribution, matrix_totals, spgemm, hadamard, sparse_add, matrix_unequal,
    kron_product, kron_generate, kron_degree_distribution, kron_check, decimate, triangle_count, triangle_count_algebra, triangle_count_lower, triangle_enumerate, triangle_vertex_degree, triangle_edge_degree,
    edge_support, k_counts, ktruss_3, ktruss_5, dnn_layer, dnn_infer_3, dnn_categories, block_edge_counts, block_degrees, data_entropy, row_entropy, overall_entropy, merge_delta_entropy, best_merge,
    move_delta_entropy, hastings_ratio, neighbour_blocks, contingency, pair_metrics, information_metrics, matching_accuracy, snowball_depth, snowball_stages, emerging_stages, arrival_ids, stream_block_counts,
    sbp_sweep, sbp_partition, sbm_generate, rmat_generate, triangle_count_incidence, edge_corners, file_edges, file_edges_from_one, file_labels, file_label_lines, file_pieces, file_triples, file_matrix_market,
    file_matrix_market_symmetric, file_layers, file_categories, file_distribution, file_factor, file_stages, run_statistics, round_robin, stride_order,
)}

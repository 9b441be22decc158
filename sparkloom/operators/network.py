"""Inference of sparse deep neural networks: features ``row, neuron, val``, weights ``layer, i, j, w``, a bias a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.shared import cut, new_path

#: The bias that goes with each number of neurons, and the cap.
BIAS = {1024: -0.30, 4096: -0.35, 16384: -0.40, 65536: -0.45}
CAP = 32.0
CUT_EVERY = 8


def layer(y: DataFrame, w: DataFrame, bias: float, cap: float = CAP) -> DataFrame:
    """One layer: the bias goes to non-zero sums only, and what is positive then stays, up to the cap."""
    sums = y.join(w, y["neuron"] == w["i"]).groupBy("row", "j").agg(F.sum(F.col("val") * F.col("w")).alias("z"))
    biased = sums.where("z <> 0").select("row", F.col("j").alias("neuron"), (F.col("z") + bias).alias("val"))
    return biased.where("val > 0").withColumn("val", F.least("val", F.lit(cap)))


def infer(y: DataFrame, weights: DataFrame, biases: list[float], cap: float = CAP) -> DataFrame:
    """All layers in turn, layer numbers from 1; weights are written once, by layer, and lineage is cut every few layers."""
    path = new_path(weights.sparkSession, "weights")
    weights.select("layer", "i", "j", "w").write.partitionBy("layer").parquet(path)
    schema = ", ".join(f"{c} {dict(weights.dtypes)[c]}" for c in ("i", "j", "w", "layer"))
    by_layer = weights.sparkSession.read.schema(schema).parquet(path)
    for k, bias in enumerate(biases, 1):
        y = layer(y, by_layer.where(F.col("layer") == k).select("i", "j", "w"), bias, cap)
        if k % CUT_EVERY == 0 and k < len(biases):
            y = cut(y, "layer")
    return y


def run_rate(rows: int, edges: int, seconds: float) -> float:
    """Edges gone through a second, as benchmarks of such networks report it: rows times weights by seconds."""
    return rows * edges / seconds


def timed_infer(y: DataFrame, weights: DataFrame, biases: list[float], cap: float = CAP) -> tuple[DataFrame, dict[str, float]]:
    """What ``infer`` gives, written, and the figures of the run: rows, edges, seconds and rate."""
    import time

    began = time.monotonic()
    found = cut(infer(y, weights, biases, cap), "inferred")
    seconds = time.monotonic() - began
    rows, edges = y.select("row").distinct().count(), weights.count()
    return found, {"rows": float(rows), "edges": float(edges), "seconds": seconds, "rate": run_rate(rows, edges, seconds)}


def categories(y: DataFrame) -> DataFrame:
    """Rows with a non-zero sum."""
    return y.groupBy("row").agg(F.sum("val").alias("s")).where("s <> 0").select("row")


def compare_categories(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows in one of the two alone: ``row, side``; empty if they agree."""
    missing = truth.select("row").join(found, "row", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.join(truth.select("row"), "row", "left_anti").withColumn("side", F.lit("unexpected")))

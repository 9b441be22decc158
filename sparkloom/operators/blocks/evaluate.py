"""How well one labelling agrees with another: ``node, block`` against ``node, block``."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import choose2, xlogx


def contingency(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``truth, found, n``: nodes by both labels; nodes that one of them lacks are left out."""
    left = truth.where("block is not null").select("node", F.col("block").alias("truth"))
    right = found.where("block is not null").select("node", F.col("block").alias("found"))
    return left.join(right, "node").groupBy("truth", "found").agg(F.count("*").alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    """One row: total, and sums over cells, rows and columns of n², C(n, 2) and n ln n."""

    def of(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias(f"{name}_squares"), F.coalesce(F.sum(choose2(F.col("n"))), F.lit(0.0)).alias(f"{name}_pairs"), F.coalesce(F.sum(xlogx(F.col("n"))), F.lit(0.0)).alias(f"{name}_logs"))

    rows = table.groupBy("truth").agg(F.sum("n").alias("n"))
    columns = table.groupBy("found").agg(F.sum("n").alias("n"))
    return of(table, "cell").crossJoin(of(rows, "truth").drop("total")).crossJoin(of(columns, "found").drop("total"))


def pair_metrics(table: DataFrame) -> DataFrame:
    """One row: rand, adjusted_rand, pair_recall, pair_precision, pair_f1; null where nothing is divided by."""
    s = _sums(table)
    n = F.col("total")
    ratio = lambda a, b: F.when(b != 0, a / b)
    same = (F.col("cell_squares") - n) / 2
    apart = (n * n + F.col("cell_squares") - F.col("truth_squares") - F.col("found_squares")) / 2
    chance = F.when(n > 1, F.col("truth_pairs") * F.col("found_pairs") / choose2(n))
    s = s.select(
        ratio(same + apart, choose2(n)).alias("rand"),
        ratio(F.col("cell_pairs") - chance, (F.col("truth_pairs") + F.col("found_pairs")) / 2 - chance).alias("adjusted_rand"),
        ratio(same, F.col("truth_pairs")).alias("pair_recall"),
        ratio(same, F.col("found_pairs")).alias("pair_precision"),
    )
    p, r = F.col("pair_precision"), F.col("pair_recall")
    return s.withColumn("pair_f1", ratio(2 * p * r, p + r))


def information_metrics(table: DataFrame) -> DataFrame:
    """One row: entropies of both labellings, of each given the other, what they share, and the missed and wrong shares."""
    s, n = _sums(table), F.col("total")
    s = s.select(
        (F.ln(n) - F.col("truth_logs") / n).alias("h_truth"),
        (F.ln(n) - F.col("found_logs") / n).alias("h_found"),
        (F.ln(n) - F.col("cell_logs") / n).alias("h_both"),
    )
    shared = F.col("h_truth") + F.col("h_found") - F.col("h_both")
    s = s.select("h_truth", "h_found", (F.col("h_both") - F.col("h_found")).alias("h_truth_given_found"), (F.col("h_both") - F.col("h_truth")).alias("h_found_given_truth"), shared.alias("mutual"))
    return s.withColumn("missed", F.when(F.col("h_truth") > 0, F.col("h_truth_given_found") / F.col("h_truth")).otherwise(0.0)).withColumn("wrong", F.when(F.col("h_found") > 0, F.col("h_found_given_truth") / F.col("h_found")).otherwise(0.0))


def best_matching(cells: list[tuple[int, int, int]]) -> int:
    """The greatest total weight of a matching, of cells ``row, column, weight`` with weights over 0.

    Rows are matched one after another along the cheapest path of reduced costs (Dijkstra with potentials); a row may stay
    alone at no cost, which a column of its own with weight 0 stands for. Only cells are held, no matrix.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for r, c, w in cells:
        rows.setdefault(r, []).append((c, w))
    for r, own in rows.items():
        own.append((-1 - r, 0))  # columns are from 0
    price: dict[int, int] = {}
    gain = {r: max(w for _, w in own) for r, own in rows.items()}
    owner: dict[int, int] = {}
    taken: dict[int, int] = {}
    for free in sorted(rows):
        far: dict[int, int] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[int, int]] = []
        row, base, settled = free, 0, []
        while True:
            for c, w in rows[row]:
                d = base + gain[row] - w + price.get(c, 0)
                if c not in done and d < far.get(c, d + 1):
                    far[c], came[c] = d, row
                    heapq.heappush(heap, (d, c))
            while heap[0][1] in done or heap[0][0] > far[heap[0][1]]:
                heapq.heappop(heap)
            base, c = heapq.heappop(heap)
            done.add(c)
            settled.append((c, base))
            if c not in owner:
                break
            row = owner[c]
        for c_seen, d in settled:
            if c_seen in owner:
                gain[owner[c_seen]] -= base - d
            price[c_seen] = price.get(c_seen, 0) + base - d
        gain[free] -= base
        while True:  # hand the columns down the path
            row = came[c]
            owner[c], before = row, taken.get(row)
            taken[row] = c
            if row == free:
                break
            c = before
    weight = {(r, c): w for r, own in rows.items() for c, w in own}
    return sum(weight[r, c] for r, c in taken.items())


def components_of(table: DataFrame) -> DataFrame:
    """``truth, found, n, part``: cells that share a block have one part, the least ``truth`` that can be reached."""
    from sparkloom.plans.shared import cut

    cells = cut(table.withColumn("part", F.col("truth")), "cells")
    while True:
        by_found = cells.groupBy("found").agg(F.min("part").alias("p"))
        by_truth = cells.drop("part").join(by_found, "found").groupBy("truth").agg(F.min("p").alias("p"))
        now = cut(cells.join(by_truth, "truth").select("truth", "found", "n", "part", "p"), "cells")
        if not now.where("part <> p").limit(1).count():
            return cells
        cells = now.select("truth", "found", "n", F.col("p").alias("part"))


def accuracy(table: DataFrame) -> float:
    """Share of nodes on the diagonal of the best matching of blocks; exact for any number of them.

    Blocks that no cells connect can't take each other's partners, so each connected part of the table is matched in a task
    of its own, which holds that part's cells.
    """
    kind = dict(table.dtypes)["truth"]

    def match(part: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.factorize(part["truth"], sort=True)[0], pd.factorize(part["found"], sort=True)[0]
        best = best_matching(list(zip(a.tolist(), b.tolist(), part["n"].tolist(), strict=True)))
        return pd.DataFrame({"part": part["part"][:1], "best": [best], "whole": [part["n"].sum()]})

    found = components_of(table).groupBy("part").applyInPandas(match, f"part {kind}, best long, whole long").agg(F.sum("best"), F.sum("whole")).first()
    return found[0] / found[1] if found[1] else 0.0


def run_statistics(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, runs, mean, spread``: number, mean and standard deviation (of the runs as a whole) of repeated runs."""
    return runs.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def evaluate(truth: DataFrame, found: DataFrame) -> dict[str, float]:
    """All measures by name."""
    from sparkloom.plans.shared import cut

    table = cut(contingency(truth, found), "contingency")
    out = {"nodes": float(found.count()), "blocks": float(found.select("block").distinct().count()), "accuracy": accuracy(table)}
    return out | pair_metrics(table).first().asDict() | information_metrics(table).first().asDict()

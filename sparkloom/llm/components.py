"""Connected components of a graph of links, by local contraction and alternating large-star and small-star steps.

Links are dealt to tasks of at most ``LINKS_A_TASK``, each of which contracts its own by union-find; as long as one task
holds them all, that is the answer. Beyond, star steps join what the tasks found. A star step is a group-by minimum and a
join on the same key, so no vertex's neighbours ever meet in one task's memory, and a hub is a skewed join that adaptive
execution splits. The links of each round are written to the shared folder, which cuts the lineage and survives lost
executors. The number of rounds grows with the logarithm of the longest path between the tasks' components.

Cases: repeated links, links both ways and links of an id with itself change nothing; a link with a null end is left out; an
id without a link to another is not in the result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """``links`` go from the larger id to the smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


LINKS_A_TASK = 200_000


def contract(links: DataFrame, tasks: int) -> DataFrame:
    """``u, v`` with ``v`` the least of the component that a task's own links put ``u`` in."""

    def run(batches):
        up: dict = {}

        def root(x):
            top = x
            while top in up:
                top = up[top]
            while x != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        kind = batch.column(0).type if up else pa.int64()
        for part in [list(up)[k : k + 10_000] for k in range(0, len(up), 10_000)]:
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["u", "v"])

    return links.select("u", "v").coalesce(tasks).mapInArrow(run, links.select("u", "v").schema)


def components(links: DataFrame, a: str = "a", b: str = "b", links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """``id, component``: the smallest id reachable, for every id with a link to another."""
    now = materialise(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    n = now.count()
    if n <= links_a_task:
        now = materialise(contract(now, 1), "links") if n else now
    else:
        now = materialise(contract(now, -(-n // links_a_task)), "links")
        before = checksum(now)
        while True:
            now = materialise(small_star(large_star(now).distinct()), "links")
            after = checksum(now)
            if after == before:
                break
            before = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

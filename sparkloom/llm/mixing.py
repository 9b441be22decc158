"""Mix sources to target weights with DataFrame functions alone.

Sizes are summed per source before anything is shuffled, so a source that holds a third of all rows costs no more
than another. Targets are found by water filling: every source gets its weight's share of the whole, no source more
than ``max_repeat`` times its size, and what that cuts off is shared anew by weight. With the sources ordered by
``cap / weight`` a prefix of them is capped, so running sums give the answer in one pass over one row a source.

A document is then taken ``floor(rate)`` times, and once more with probability ``rate - floor(rate)``; the draw is a
hash of seed and document, so reruns agree under any partitioning.

Cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, ordered last; sources
of size 0 have target 0; an empty table gives an empty result; repeated rows of one id share one draw; other columns
are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh, materialise, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
SEED = "mix-1"
#: The rates are broadcast up to this many sources, and joined by shuffle beyond.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from a hash of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target, rate``; one row a source.

    Weights are 1, 2, 3, 1, 2, 3, ... by code point of the source, null last.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("ratio", "place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    d = sizes.select(
        "source",
        "source_size",
        F.row_number().over(by_name).alias("place"),
        F.sum("source_size").over(every).alias("whole"),
    )
    d = d.select(
        "*",
        ((F.col("place") - 1) % 3 + 1).cast("double").alias("weight"),
        (F.col("source_size") * max_repeat).cast("double").alias("cap"),
    )
    d = d.withColumn("ratio", F.col("cap") / F.col("weight"))
    d = d.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("weight").over(every).alias("weight_all"),
    )
    level = (F.col("whole") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    d = d.withColumn("level", F.when(level <= F.col("ratio"), level))
    d = d.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("ratio", "place"))).over(every))
    d = d.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return d.select("source", "source_size", "target", rate.alias("rate"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_repeat: int = MAX_REPEAT, seed: str = SEED) -> tuple[DataFrame, str]:
    """``docs`` with a struct column ``size, source_size, target, copies``, and that column's name.

    copies is how often the mix takes the row. The name is free of clashes with the columns of ``docs``.
    """
    name, size, rates_of = fresh(docs, "mix"), fresh(docs, "mix_size"), fresh(docs, "mix_rates")
    sized = docs.withColumn(size, word_count(F.col(text)))
    totals = materialise(sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), "source_sizes")
    rates = targets(totals, max_repeat).select(F.struct("source", "source_size", "target", "rate").alias(rates_of))
    if totals.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, F.col(source).eqNullSafe(F.col(f"{rates_of}.source")), "left")
    rate = F.col(f"{rates_of}.rate")
    whole = F.floor(rate)
    copies = (whole + F.when(draw(F.col(key), seed) < rate - whole, 1).otherwise(0)).cast("long")
    found = F.struct(F.col(size).alias("size"), F.col(f"{rates_of}.source_size").alias("source_size"), F.col(f"{rates_of}.target").alias("target"), copies.alias("copies"))
    return joined.withColumn(name, found).drop(size, rates_of), name


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with its own columns, each repeated as often as the mix takes it."""
    mixed, name = mix(docs, **options)
    return mixed.where(F.col(f"{name}.copies") > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies")))).drop(name)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, name = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.col(f"{name}.size") * F.col(f"{name}.copies")
    return mixed.select("doc_id", f"{name}.size", f"{name}.source_size", f"{name}.target", taken.alias("taken"))


#: The same in DuckDB.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place, CAST(sum(source_size) OVER () AS BIGINT) AS whole FROM totals
), weighed AS (
  SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap,
         CAST(source_size * 3 AS DOUBLE) / CAST((place - 1) % 3 + 1 AS DOUBLE) AS ratio
  FROM placed
), running AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weight_before,
         sum(weight) OVER () AS weight_all
  FROM weighed
), levels AS (
  SELECT *, (whole - cap_before) / (weight_all - weight_before) AS level FROM running
), chosen AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1
), filled AS (
  SELECT source, source_size, least(cap, (SELECT level FROM chosen) * weight) AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM filled
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST(s.size * (floor(r.rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || s.doc_id), 1, 8) AS BIGINT) / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""

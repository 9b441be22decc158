"""Token counts through a digest cache.

A cache row is keyed by the digest of a text's normalised content and the digest of the tokenizer's file, and holds
the counts. A call

1. digests every text (JVM only, the texts do not move),
2. picks one document for each distinct digest and joins the digests with the cache for those that it misses,
3. fetches the texts of those documents alone by a join on content and key together, which no group of copies can
   skew, encodes them and appends the counts to the cache,
4. joins the digests with those rows of the cache that the call asks for.

Normalisation may only merge texts that every tokenizer counts alike, so it is the least there is: a null is the empty
text. The cache is a Parquet folder, each call adding files of its own; a count that two racing calls both add is
equal in both, and step 4 reads one row a key. A count never depends on the document's key or on other columns.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and repeated keys are kept and counted row by
row; an empty table gives an empty result; whole texts are encoded, without truncation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, materialise, table
from sparkloom.plans.shared import new_path

#: Documents over so many tokens are marked.
LIMIT = 4096
SCHEMA = "content binary, tokenizer string, n_bytes long, n_tokens long"


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def load_counter(path: str):
    """Texts to token counts, as the library of the file at ``path`` gives them; no special tokens are added."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(path)
    word.no_truncation()
    word.no_padding()
    return lambda texts: [len(x) for x in word.encode_batch_fast(texts, add_special_tokens=False)]


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """``content, text`` to cache rows."""
    digest = tokenizer_digest(path)

    def make():
        count = load_counter(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = ["" if x is None else x for x in batch.column("text").to_pylist()]
            sizes = [len(x.encode()) for x in found]
            return pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([digest] * len(found), pa.string()), pa.array(sizes, pa.int64()), pa.array(count(found), pa.int64())],
                ["content", "tokenizer", "n_bytes", "n_tokens"],
            )

        return step

    return arrow_map(texts.select("text", "content"), make, SCHEMA)


def read_cache(spark: SparkSession, cache: str, digest: str, wanted: DataFrame) -> DataFrame:
    """The rows of one tokenizer version for the contents ``wanted``, one a content; empty where the folder is not there yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    # what the call does not ask for is not grouped, however large the cache has grown
    asked = rows.where(F.col("tokenizer") == digest).join(wanted.select("content").hint("shuffle_hash"), "content", "left_semi")
    return asked.groupBy("content").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` for each row of ``docs``; counts new contents and appends them to ``cache``."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    digested = rows.withColumn("content", content_digest(F.col("text")))
    # digested once for all that follows but the fetch; the texts do not move
    digests = materialise(digested.select("key", "content"), "digests")
    # copies are counted together before they are shuffled, so they are no hot key of the join
    distinct = materialise(digests.groupBy("content").agg(F.min("key").alias("first_key")), "contents")
    missing = distinct.join(read_cache(spark, cache, version, distinct), "content", "left_anti")
    # the small side is built: documents stream past it and are neither sorted nor spilt
    texts = digested.join(missing.hint("shuffle_hash"), (digested["content"] == missing["content"]) & digested["key"].eqNullSafe(missing["first_key"]), "left_semi")
    encode_misses(texts, path).write.mode("append").parquet(cache)
    # written, so that the join reads plain shuffles: a group of copies of any size is then split by adaptive execution
    found = digests.join(materialise(read_cache(spark, cache, version, distinct), "counts"), "content")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of ``documents`` by the sentencepiece model, from a cache that starts empty."""
    import public_tokenizers

    cache = new_path(spark, "token-cache")
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

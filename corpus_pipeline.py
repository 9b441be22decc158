"""From raw documents to token ids: filter, deduplicate, redact, mix, encode.

Each stage gets all that the one before kept, is written as Parquet to the shared folder and read again, so a lost executor
costs a stage at most. Every stage but the last returns the columns of ``documents``.

Cases: an empty table goes through all stages. A null text is the empty text to the classifier, has no near-duplicates, holds
no secrets, has size 0 in the mix, so it is taken at its source's rate like any other, and no ids. Rows with a null or
repeated ``doc_id`` are documents each until near-duplicates go, of which one of each group stays; of ties the smallest id
does. Very long texts go through whole. Other columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import byte_bpe, mixing, near_dups, quality, secrets
from sparkloom.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores low go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, a similarity of 0.8."""
    return near_dups.drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target says."""
    return mixing.emit(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("secrets", secret_stage),
    ("mixing", mix_stage),
    ("byte_bpe", encode_stage),
]

#: The classifier is fitted and the encoder folds merges, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

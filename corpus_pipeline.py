"""A corpus pipeline of five stages over `documents`: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, minhash, mixing, pii, quality
from veilspark.session import drop_written, table, written, written_so_far


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id. Five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked; n_chars is the new text's."""
    masked = pii.redact(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: the words taken over the size, rounded half up; none twice over three."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of every document's ids, and its ids."""
    return bpe.encode(docs, bpe.default_bpe(), digests_too=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("personal data", private_data), ("mixture", mixture), ("tokens", tokens)]

#: The personal-data stage has a trained model, and the last stage a byte-pair encoder: no SQL for these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage left in the shared folder goes when its output is written, and so does its input."""
    docs, since = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)

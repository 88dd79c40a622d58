"""A corpus pipeline: each stage reads what the one before it wrote as Parquet.

Stages: documents that the quality classifier rejects go; one document of each near-duplicate group stays;
secrets are masked; sources are mixed to target weights (a document stands once for each pass that takes it);
the mix is segmented into SentencePiece ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracery.llm import mixing, neardup, pieces, quality, secrets
from tracery.llm.common import shared_folder

#: Bytes of text that piece encoding takes at once. Its workers keep what they took, beside an executor that four stages have filled already.
ENCODED_AT_ONCE = 1 << 20


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates here share 80 % of their five-word shingles."""
    return neardup.keep_one(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One sampled segmentation and the next, with their ids; rows that the mix repeats are numbered, and each is seeded by its number too."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id are told apart by their texts
    again = Window.partitionBy("doc_id", own).orderBy(F.desc("n_chars"))
    numbered = docs.withColumn("repeat", F.row_number().over(again))
    return pieces.segment(numbered, "text", F.struct("doc_id", "repeat"), F.col("doc_id"), F.col("source"), F.col("repeat"), with_ids=True, chunk=ENCODED_AT_ONCE)


STAGES = [("quality classifier", classify), ("near-dedup", deduplicate), ("secret scans", mask_secrets), ("mixing to weights", mix), ("piece encoding", encode)]
#: The classifier's arithmetic and the sampled segmentations have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

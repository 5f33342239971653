"""Training-data pipeline over ``documents``: from raw documents to packed token windows.

Every stage works on all that the one before it kept, written as Parquet and read again.
Rejected documents go; personal data is replaced in the texts; the last stage returns the
pieces of the packed windows with their ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspectra.llm import neardup, packing, pii, quality, toxicity
from jobspectra.session import shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.judge(docs).where("kept").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model learned from the labelled ones among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, 0.8)."""
    gone = neardup.near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; the length follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, with ids and their checksum."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", keep_good),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_copies),
    ("personal data", redact_personal),
    ("packing", pack_windows),
]

#: Trained scores and packing are beyond SQL; tests compare every stage with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: toxic documents go, then copies, then near copies; what stays is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is
written as Parquet and read back as the next stage's docs. The first three return the columns of
documents; the last returns pieces of packed sequences.

Defined results: null texts are empty ones, and empty texts are copies of each other; null and
repeated ids are ids like others (each row is a document of its own); texts of any length are read
whole; further columns of any name pass through the first three stages; empty tables pass through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup, packing, part_enum, toxicity
from riskloom.llm.common import stash, table
from riskloom.llm.queries import vocabulary


#: Rows that Spark hands to a Python worker at once. Texts may be long, and each batch is held on both sides.
ARROW_ROWS = 1_000


def bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    bounded(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.clean(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the longest, then the one with the smallest id."""
    bounded(spark)
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share three quarters of their word shingles, the one with the smallest id."""
    bounded(spark)
    return part_enum.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    bounded(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("packing", packed),
]

#: The classifiers and the tokenizer have no SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs

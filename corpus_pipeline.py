"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reefline.llm import exact_dedup, minhash, mixing, packing, quality
from reefline.llm.common import read, stored
from reefline.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on the labelled ones, scores under the threshold."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accept(docs, quality.fit(docs, labels))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) keep the least doc_id."""
    return minhash.deduplicate(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole documents, some twice, some not at all."""
    return mixing.materialise(docs, mixing.mix(docs, F.array("source")))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences, with digests of their ids."""
    return packing.pack(docs, tokenizer_path(), digests=True)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]
# Training, banding and tokenizing are not SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

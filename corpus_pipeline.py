"""A corpus pipeline over `documents`: toxic documents, exact and near copies and benchmark passages go, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and reads it again as the
next one's docs.  All but the last return the columns of documents.  Null texts count as empty: they are not toxic and not
contaminated, and as copies of each other one of them stays.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import byte_bpe, decontaminate, exact_dedup, near_copies as near, toxicity as toxic
from helixframe.llm.common import free_name, remove, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learnt from the labelled ones, predicts to be toxic."""
    return toxic.drop_toxic(docs, toxic.fit_from_labels(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for capital A-Z, the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    SimHash fingerprints propose pairs; five-word shingles with a similarity of 0.8 or more decide.
    """
    return near.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs."""
    name = free_name(docs, "hit")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), name=name).where(f"NOT `{name}`.contaminated").drop(name)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    return byte_bpe.digests(docs, *byte_bpe.vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: The classifier and the fingerprints have no equal in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    out = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{out}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs

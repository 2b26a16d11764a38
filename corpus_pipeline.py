"""From raw documents to packed sequences: quality, exact copies, near copies, packing.

``run`` writes every stage's rows as Parquet to the shared folder and reads them as the
next one's documents, so a stage that fails is rerun from what its predecessor kept.

Defined cases: a null text counts as empty; empty texts are one group of equals, without words, so
near dedup leaves the one that stays alone; every stage decides for each row apart, so rows
without id, or with one that others share, are neither lost nor kept for another's sake; of equal rows one
stays; very long texts are taken whole; columns of any name are carried to the last stage, which
returns the pieces; an empty table gives an empty result, and documents without any label of the training fold raise a ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact, neardup, packing, quality
from skein.llm.common import discard, materialise, rest, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the training fold, accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return neardup.drop_near(docs, k=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if hasattr(docs, "skein_path"):  # a stage's rows go when the next one's are stored
            discard(docs)
        docs = kept
        rest(spark)
    return docs

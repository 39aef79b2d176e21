"""The corpus pipeline: stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
below the shared folder and rereads it as the next stage's documents. All but the last keep the
columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import decontaminate, language_id, near_copies, queries, simhash_index, surrogates
from sensorloom.llm.stores import store
from sensorloom.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with an ambiguous language go.

    So do null and empty texts. Equal texts share their fate. Without labelled documents no language
    is known and all go; an empty table stays empty.
    """
    return language_id.accepted(docs, language_id.train(docs.where(~language_id.held_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-copies (five-word Jaccard similarity of 0.8 or more) stays.

    SimHash fingerprints pair the texts, an exact check decides, and prefix filtering adds the links that lie too far
    apart for the fingerprints. Texts without words, null ones too, are one group. Of rows that share a doc_id one stays; rows
    without a doc_id all stay. An empty table stays empty.
    """
    return simhash_index.smallest_stay(docs, near_copies.near_copies(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts hold nothing and stay. An empty table stays empty.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; every document stays.

    Null texts stay null, empty ones as they are; equal values get equal surrogates in all documents.
    """
    return surrogates.rewritten(docs, queries.pii_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text is one piece, its closing id 0. An empty table gives no pieces.
    """
    return queries.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii_surrogates", replace_private),
    ("bin_slack_packing", pack),
]

# Trained models, hashing and packing are not SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

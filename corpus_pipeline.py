"""Corpus preparation in stages, each one operator over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns documents with the same
columns; the last returns token ids.  ``run`` writes what a stage returns as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontamination import remove_contamination
from millrace.llm.jaccard import keep_one
from millrace.llm.language import fit_documents, keep_identified
from millrace.llm.pii import remove_pii
from millrace.llm.sentencepieces import encode
from millrace.llm.shared import written


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; those too far from any centroid, or without a letter, go."""
    return keep_identified(docs, fit_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return keep_one(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return _measured(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced."""
    return _measured(remove_pii(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal-data", sanitise),
    ("sentencepiece", tokenise),
]

#: The stages learn centroids, hash and merge pieces, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

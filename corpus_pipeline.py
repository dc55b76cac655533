"""Corpus pipeline: the stages that turn ``documents`` into training tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, queries, simhash, toxicity
from tessera.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any recognisable language go."""
    return langid.keep_known(docs, queries.language_labels(docs))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group stays, the one with the smallest id."""
    return simhash.keep_one(docs, shingle_words=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), width=13)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left."""
    coder = bpe.ByteBpe(spark, queries.RANKS, public_tokenizers.PATTERN)
    coded = docs.select("doc_id", coder.encode(F.col("text")).alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

# The stages fit models and merge components: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus out of raw documents: stages that each read what the one before them kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, cotrain, mixing, pii, simhash
from callscope.llm.batches import small_batches
from callscope.sources.storage import stored

VOCABULARY = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; all of them if no label tells both kinds apart. Null texts count as empty ones."""
    small_batches(spark)
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Null and empty texts are one group; rows without an id are kept."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data marked out in their texts; n_chars follows. Null texts stay null."""
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none of a source with a target of no words. Null sources are a source, null texts have no words."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of the text's tokens and their number, a row for each row; null and empty texts have no tokens."""
    small_batches(spark)
    found = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), keep=["source"])
    return found.select(F.col("id").alias("doc_id"), "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]
#: SQL has no co-trained classifier and no byte-pair encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

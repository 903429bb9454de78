"""The corpus pipeline over ``documents``: language ID, one document of each near-duplicate group,
no documents with benchmark windows, sources mixed to their targets, token files.

Each stage reads all that its predecessor kept, and all but the last return the columns of
``documents``. The last returns, per document as it stands in the token files, its place,
length and checksum.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselens.llm import op2_token_files, op6_language_id, op7_jaccard_join, op8_mixing, op9_decontamination
from caselens.scratch import write_and_reread
from caselens.shipping import ship


#: Near copies are judged on shingles of this many words and this least share in percent; the
#: query of operator 7 has values of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough."""
    ship(spark)
    return op6_language_id.accepted(docs, **op6_language_id.document_evidence())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    ship(spark)
    groups = op7_jaccard_join.near_groups(docs, NEAR_PERCENT, shingle=NEAR_WORDS)
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ship(spark)
    return op9_decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    ship(spark)
    return op8_mixing.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, read back."""
    ship(spark)
    return op2_token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("token_files", token_files),
]
ORACLE_SQL = None  # neither the text model nor the random rounding can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_reread(stage(spark, docs, sf_dir), name)
    return docs

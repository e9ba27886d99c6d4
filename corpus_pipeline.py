"""The training-data pipeline: documents in, packed sequences out.

Each stage works on all that its predecessor kept; all but the last return the columns of
``documents``. A null text is kept as a document without words; the pieces of the last stage come
from every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm import packing, simhash, substring, toxicity
from vestige.llm.common import table, written
from vestige.llm.queries import tokenizer_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from two thirds of the labels."""
    labels = table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id"), 3) != 1)
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a window of 35 words covers which occurs elsewhere too."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL can express none of the stages; the tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

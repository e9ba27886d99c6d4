"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html, iblt, packing, pst, simhash, substring, tokencount, toxicity
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), digests=True)
    return out.withColumnRenamed("kept", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = toxicity.fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_edits(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = pst.score(docs, pst.learn(pst.training_rows(docs)))
    return scored.withColumn("held_out", toxicity.fold(F.col("doc_id"), 5) == 1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    return tokencount.count_tokens(docs, path, public_tokenizers.PATTERN, ["source", "lang", "text"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_nearest": op6_nearest,
    "op7_fingerprints": op7_fingerprints,
    "op8_html_text": op8_html_text,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {}

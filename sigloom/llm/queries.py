"""Queries op1..op13 over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bloomlm, captures, counts, decontaminate, divergence, language, packing, pii, pivots, preference, rotatedbits, simhash, substrings


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(blocks.documents(spark, sf_dir), width=13, texts=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(blocks.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048, end_id=1)


def op3_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(blocks.documents(spark, sf_dir), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.token_counts(blocks.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotatedbits.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(blocks.documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = blocks.documents(spark, sf_dir)
    return pii.find(documents, pii.train(documents))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(blocks.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(blocks.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures.read_back(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(blocks.documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivots.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_packing": op2_packing,
    "op3_chat_preference": op3_chat_preference,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_model": op7_language_model,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_warc": op11_warc,
    "op12_divergence": op12_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op3_chat_preference": preference.ORACLE,
    "op11_warc": captures.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_hard_negatives": pivots.ORACLE,
}

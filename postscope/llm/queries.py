"""Queries ``opN_<name>``: each operator over its whole table, as the digest its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (chat_format, collocations, decontaminate, hard_negatives, jaccard_join, kd_shards, language_id, licenses, packing, repair_store, substring_dedup, toxicity,
               vector_join)
from .common import crc_text, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_text(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    repair_store.write(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return repair_store.read(spark, path)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_text(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = language_id.fit(docs.filter(~held_out), language_id.vocabulary(PIECES))
    return language_id.identify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_toxicity": op2_toxicity,
    "op3_token_ids": op3_token_ids,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_kd_shards": op5_kd_shards,
    "op7_language_id": op7_language_id,
    "op10_packing": op10_packing,
}


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


QUERIES["op8_ngram_jaccard_join"] = op8_ngram_jaccard_join


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES["op9_substring_dedup"] = op9_substring_dedup


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.linked(table(spark, sf_dir, "embeddings"))


QUERIES["op1_embedding_near_dedup"] = op1_embedding_near_dedup


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_families(table(spark, sf_dir, "documents"))


QUERIES["op6_license_scan"] = op6_license_scan


# a conversation that holds the template's own marks, formatted with the table
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "formatted-chats")
    chat_format.write(rows.unionByName(probe), path)
    return chat_format.conversations(spark.read.parquet(path))


QUERIES["op11_chat_format"] = op11_chat_format


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


QUERIES["op12_hard_negatives"] = op12_hard_negatives


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES["op13_collocations"] = op13_collocations

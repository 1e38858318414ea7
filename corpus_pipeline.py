"""The corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postscope.llm.common import remove
from postscope.llm.stages import decontaminated, known_language, packed, unique_documents, without_repeats
from postscope.session import scratch_path

STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", unique_documents),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

# language models and tokenizers are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables of the stages before it are removed when they have been read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs

"""The pipeline's stages; each reads the operator's result and gives the rows it keeps.

Operators return a document's id and a hash of its text; the rows themselves are
found again by hashes of both.  A stage stores what it decided (ids and hashes,
or the texts that change) and removes the scratch tables of its operator.

Defined cases: rows without an id or a text take part like others; of repeated
rows one stays behind the Jaccard join; an empty table gives none; columns of
``documents`` keep their names, order and types, whatever other columns it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, packing, substring_dedup
from .common import decided, table
from .queries import BYTE_BPE, PIECES

# a language is unknown below this posterior
MIN_POSTERIOR = 0.5
# shortest repeated passage that goes, in bytes: 51 words of two letters and their spaces; and the sampling reach below it
SPAN, REACH = 152, 128
_KEY = ["_id_hash", "_text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id_hash": F.xxhash64("doc_id"), "_text_hash": F.xxhash64("text")})


def _keys(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.xxhash64("doc_id").alias("_id_hash"), F.col("t64").alias("_text_hash"), *more).dropDuplicates(_KEY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or without a clear language go."""
    model = language_id.fit(docs, language_id.vocabulary(PIECES))
    row = {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    found = language_id.identify(docs, model, keep=row)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_POSTERIOR)).select("row.*")


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class stays (of repeated rows, one row)."""
    kept = decided(spark, lambda: _keys(jaccard_join.near_duplicates(docs).filter("kept")), "kept-documents")
    return _keyed(docs).join(kept.hint("merge"), _KEY).dropDuplicates(_KEY).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix search: passages of ``SPAN`` bytes or more that stand elsewhere leave the texts, all copies of them
    (behind the Jaccard join no two documents are copies as a whole); every document stays."""
    cut = decided(spark, lambda: _keys(substring_dedup.repeated_passages(docs, span=SPAN, reach=REACH)
                                       .filter("kept_text is not null"), "kept_text"), "cut-documents")
    text = F.coalesce("kept_text", "text")
    new = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length(text))
           if "n_chars" in docs.columns else F.lit(None)}
    return _keyed(docs).join(cut, _KEY, "left").select(
        *[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that the contamination rule marks go."""
    benchmark = table(spark, sf_dir, "benchmark")
    gone = decided(spark, lambda: _keys(decontaminate.contamination(docs, benchmark).filter(decontaminate.is_contaminated())),
                   "contaminated-documents")
    return _keyed(docs).join(gone, _KEY, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents and their places."""
    return decided(spark, lambda: packing.packed(docs, BYTE_BPE, end_id=2), "packed-pieces")

"""Bookshelf JSON arrays and per-account run parameters.

Explicit schemas, no inference; missing keys become null and then take the
documented defaults; secrets present in the files are never selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import safe_int
from ..operators.quota import COMMENTS_CAP, LIKES_CAP
from ..schemas import RUN_PARAMS_JSON, SHELF_JSON_ITEM

# fixed value: sensitive content is allowed unless the settings say otherwise
ALLOW_SENSITIVE = True


def parse_shelf_json(texts: DataFrame, user: str = "user_id", value: str = "value") -> DataFrame:
    """``(user, JSON array text)`` -> one row per book with its 1-based list position."""
    arr = F.from_json(F.col(value), T.ArrayType(SHELF_JSON_ITEM))
    return (texts.select(user, F.posexplode(arr).alias("_pos", "_b"))
            .select(user, (F.col("_pos") + 1).cast("long").alias("position"),
                    F.col("_b.title").alias("title"), F.col("_b.author").alias("author"),
                    F.col("_b.book_url").alias("book_url"), safe_int("_b.rating").alias("rating"),
                    F.col("_b.review").alias("review")))


def read_shelf_json(spark: SparkSession, path: str) -> DataFrame:
    """S4 over files: one JSON array per file; the user is the ``user_id=...``
    folder the file lies in, or else the file's name."""
    files = spark.read.text(path, wholetext=True)
    user = (F.col("user_id").cast("string") if "user_id" in files.columns
            else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))
    return parse_shelf_json(files.select(user.alias("user_id"), "value"))


def _limit(c: str, default: int):
    """Digits only, else the default (a saved limit that is not a number).

    A number beyond the integer range counts as the largest integer: it is a
    limit that is never reached.
    """
    v = F.col(c)
    top = F.lit(2147483647)
    return F.when(v.rlike(r"^[0-9]+$"), F.coalesce(safe_int(c), top)).otherwise(F.lit(default))


def parse_run_params(texts: DataFrame, value: str = "value", account_key: str = "account") -> DataFrame:
    """One settings object per row -> typed parameters with defaults.

    ``account_key`` names the settings field holding the account name.
    Only the listed keys are parsed, so secrets never enter the plan.
    """
    schema = T.StructType([T.StructField(account_key, T.StringType(), True), *RUN_PARAMS_JSON.fields])
    p = F.from_json(F.col(value), schema)
    empty = F.array().cast("array<string>")
    return texts.select(p.alias("_p")).select(
        F.col("_p")[account_key].alias("account"),
        F.coalesce("_p.hashtags", empty).alias("hashtags"),
        F.coalesce("_p.avoid_hashtags", empty).alias("avoid_hashtags"),
        _limit("_p.likes_per_day", LIKES_CAP).alias("likes_per_day"),
        _limit("_p.comments_per_day", COMMENTS_CAP).alias("comments_per_day"),
        F.coalesce("_p.allow_sensitive", F.lit(ALLOW_SENSITIVE)).alias("allow_sensitive"),
        F.col("_p.goodreads_user_id").alias("shelf_user_id"),
    )


def read_run_params(spark: SparkSession, path: str, account_key: str = "account") -> DataFrame:
    """S5 over settings files: one (pretty-printed) JSON object per file, or an array of them."""
    whole = spark.read.text(path, wholetext=True)
    one = F.array("value")
    # an element is kept as its JSON text; an array that is cut short stays one unparsable object
    several = F.coalesce(F.from_json("value", T.ArrayType(T.StringType())), one)
    objects = whole.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), several).otherwise(one)).alias("value"))
    return parse_run_params(objects, account_key=account_key)

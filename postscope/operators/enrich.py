"""Post enrichment: J2 author, J3 follow flag, J4 book-title match, F6/F9-F15.

Joins are equi-joins on ids cast to text (Q17), so AQE may turn them into
broadcasts when the measured side is small and split skewed partitions
otherwise.  The title match reuses the exact substring join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import DEFAULT_LANG, language_route, relation, with_language
from ..functions.profiles import detect_by_profile
from ..functions.text import excerpt, or_missing, post_link, ustrip
from .substring_join import matches


def with_author(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Attach username/full name; caption defaults to ''."""
    a = authors.select(F.col("author_id").cast("string").alias("_aid"), "username", "full_name")
    return (posts.withColumn("_aid", F.col("author_id").cast("string")).join(a, "_aid", "left").drop("_aid")
            .withColumn("caption", F.coalesce("caption", F.lit(""))))


def with_following(posts: DataFrame, follows: DataFrame, viewer_id) -> DataFrame:
    """``is_following`` when the viewer follows the author (missing -> false)."""
    f = (follows.filter(F.col("follower_id").cast("string") == F.lit(str(viewer_id)))
         .select(F.col("followee_id").cast("string").alias("_aid")).distinct()
         .withColumn("is_following", F.lit(True)))
    return (posts.withColumn("_aid", F.col("author_id").cast("string")).join(f, "_aid", "left").drop("_aid")
            .withColumn("is_following", F.coalesce("is_following", F.lit(False))))


def _titles(shelf: DataFrame) -> DataFrame:
    return shelf.select("user_id", "position", F.lower(ustrip("title")).alias("_title"))


def match_titles(posts: DataFrame, shelf: DataFrame, reader: str | None = None) -> DataFrame:
    """Per post and shelf, the first book (list order) whose stripped, folded
    title occurs in the folded caption.  Output: ``media_id, user_id, position``.

    ``reader`` names the column of ``posts`` that holds the post's shelf owner;
    then only that shelf counts.  Without it every shelf gives its own row.
    """
    keys = ["media_id"] + ([reader] if reader else [])
    texts = posts.select(*keys, F.lower(F.coalesce("caption", F.lit(""))).alias("_cap"))
    found = matches(texts, keys, "_cap", _titles(shelf), ["user_id", "position"], "_title")
    rows = found.select(*keys, F.explode("matched").alias("_m")).select(*keys, "_m.*")
    if reader:
        rows = rows.filter(F.col(reader) == F.col("user_id"))
    return rows.groupBy("media_id", "user_id").agg(F.min("position").alias("position"))


def book_features(shelf: DataFrame) -> DataFrame:
    """F14 parts: title, rating when non-zero, review excerpt when non-empty."""
    return shelf.select(
        "user_id", "position",
        F.col("title").alias("book_title"),
        F.when(F.col("rating") != 0, F.col("rating")).alias("book_rating"),
        excerpt(F.when(F.col("review") != "", F.col("review"))).alias("book_review"),
    )


def title_match(posts: DataFrame, shelf: DataFrame, reader: str | None = None) -> DataFrame:
    """J4 + F14: matched book per post and shelf (posts without a match are absent)."""
    return match_titles(posts, shelf, reader).join(book_features(shelf), ["user_id", "position"], "inner")


def links(posts: DataFrame, prefix: str) -> DataFrame:
    """post link from the short code."""
    return posts.select("media_id", post_link("code", prefix).alias("post_link"))


def post_brief(details: DataFrame) -> DataFrame:
    """one factual line per post for reviewers; missing counts read N/A."""
    line = F.concat(
        F.lit("@"), F.coalesce("username", F.lit("?")), F.lit(" ("), F.coalesce("full_name", F.lit("")), F.lit(")"),
        F.lit(" likes="), or_missing("like_count"), F.lit(" comments="), or_missing("comment_count"),
        F.lit(" | "), F.coalesce("caption", F.lit("")))
    return details.select("media_id", line.alias("brief"))


def post_features(posts: DataFrame, authors: DataFrame, follows: DataFrame, shelf: DataFrame,
                  viewer_id, reader: str | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """one row per post with author, relation, language route and book.

    ``reader`` is the viewer's shelf owner (default: the only shelf given).  The
    language is an expression of the same scan, or, with ``profiles``, that of
    the trained model (``functions.profiles``).
    """
    if profiles is None:
        posts = with_language(posts, "caption")
    else:
        found = detect_by_profile(posts, profiles, "media_id", "caption").drop("margin")
        posts = posts.join(found, "media_id", "left").withColumn("lang", F.coalesce("lang", F.lit(DEFAULT_LANG)))
    d = with_following(with_author(posts, authors), follows, viewer_id)
    mine = shelf if reader is None else shelf.filter(F.col("user_id") == reader)
    books = title_match(posts.select("media_id", "caption"), mine).drop("user_id")
    return (d.join(books, "media_id", "left")
            .select("media_id", "username", "full_name", "is_following", relation("is_following").alias("relation"),
                    "lang", language_route("lang").alias("route"),
                    F.col("position").alias("book_position"), "book_title", "book_rating", "book_review"))


def complete_books(shelf: DataFrame) -> DataFrame:
    """P10: keep books that have both a title and an author."""
    return shelf.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("author", F.lit("")) != ""))

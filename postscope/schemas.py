"""Explicit schemas of the tables the engine reads (no inference anywhere)."""

from pyspark.sql import types as T

ACTIONS_V1 = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("account", T.StringType(), True),
    T.StructField("action_type", T.StringType(), False),
    T.StructField("media_id", T.StringType(), True),
    T.StructField("hashtag", T.StringType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

ACTIONS = T.StructType(ACTIONS_V1.fields + [T.StructField("post_link", T.StringType(), True)])
ACTION_COLUMNS = [f.name for f in ACTIONS.fields]

POSTS = T.StructType([
    T.StructField("media_id", T.StringType(), False),
    T.StructField("code", T.StringType(), True),
    T.StructField("author_id", T.LongType(), True),
    T.StructField("caption", T.StringType(), True),
    T.StructField("like_count", T.LongType(), True),
    T.StructField("comment_count", T.LongType(), True),
    T.StructField("hashtags", T.ArrayType(T.StringType()), True),
    T.StructField("search_tag", T.StringType(), True),
    T.StructField("taken_at", T.TimestampNTZType(), True),
])

AUTHORS = T.StructType([
    T.StructField("author_id", T.LongType(), False),
    T.StructField("username", T.StringType(), True),
    T.StructField("full_name", T.StringType(), True),
])

FOLLOWS = T.StructType([
    T.StructField("follower_id", T.LongType(), False),
    T.StructField("followee_id", T.LongType(), False),
])

TAGS = T.StructType([
    T.StructField("account", T.StringType(), False),
    T.StructField("list_name", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("raw", T.StringType(), True),
])

SHELF = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("position", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("book_url", T.StringType(), True),
    T.StructField("rating", T.IntegerType(), True),
    T.StructField("review", T.StringType(), True),
])

SHELF_PAGES = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("page", T.LongType(), False),
    T.StructField("html", T.StringType(), True),
])

VERDICTS = T.StructType([
    T.StructField("media_id", T.StringType(), False),
    T.StructField("verdict_text", T.StringType(), True),
])

# one JSON object per account; secrets in the file are never selected.
# fixed values: the settings keys (the account key is chosen by the caller)
RUN_PARAMS_JSON = T.StructType([
    T.StructField("hashtags", T.ArrayType(T.StringType()), True),
    T.StructField("avoid_hashtags", T.ArrayType(T.StringType()), True),
    T.StructField("likes_per_day", T.StringType(), True),
    T.StructField("comments_per_day", T.StringType(), True),
    T.StructField("allow_sensitive", T.BooleanType(), True),
    T.StructField("goodreads_user_id", T.StringType(), True),
])

# one element of a bookshelf JSON array
SHELF_JSON_ITEM = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("book_url", T.StringType(), True),
    T.StructField("rating", T.StringType(), True),
    T.StructField("review", T.StringType(), True),
])

"""Adapters: map the driver's parquet tables onto the engine's schemas.

Every adapter is a lazy projection over a driver table, so Catalyst still
prunes columns and pushes filters into the parquet scan.  The same mappings
are written independently in DuckDB SQL in ``postscope.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timefmt import iso_text
from ..plans.ranking import bucketed_row_number, spread
from ..session import scratch_path

# fixed values: fixture parameters (FIXTURES.md)
AS_OF = "2024-01-31 00:00:00"
HISTORY_BEFORE = "2024-01-08 00:00:00"
LINK_PREFIX = "https://posts.example/p/"
BOOK_SITE = "https://books.example"
VIEWER_ID = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an action log (ids, ISO text, typed ts, date partition)."""
    return actions_from_events(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of several micro-batches (one file each).

    The files follow the time in weeks; one event in twenty arrives a week late
    and one in fifty arrives twice.
    """
    ev = table(spark, sf_dir, "events")
    week = F.floor(F.dayofmonth("ts") / 8).cast("int")
    late = (F.col("event_id") % 20 == 0).cast("int")
    path = scratch_path(spark, "events-stream")
    for n in range(5):
        again = ev.filter((F.col("event_id") % 50 == 0) & (week == n - 1) & (late == 0))
        ev.filter(week + late == n).union(again).coalesce(1).write.parquet(f"{path}/batch={n}")
    return (spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1).parquet(path))


def actions_from_events(ev: DataFrame) -> DataFrame:
    """The action-log projection of an events frame (batch or streaming)."""
    k = F.get_json_object("props", "$.k").cast("int")
    action_type = (F.when(F.col("event_type") == "purchase", "comment")
                   .when(F.col("event_type") == "error", "error").otherwise("like"))
    media_id = k.cast("string")     # a post's id: accounts act on the same posts
    return ev.select(
        F.col("event_id").alias("id"),
        iso_text("ts").alias("timestamp"),
        F.col("ts"),
        F.col("user_id").cast("string").alias("account"),
        action_type.alias("action_type"),
        media_id.alias("media_id"),
        F.when(k >= 10, F.concat(F.lit("tag"), (k % 20).cast("string"))).alias("hashtag"),
        F.when(action_type == "comment", F.concat(F.lit("c"), k.cast("string"))).alias("comment"),
        F.when(action_type == "error", F.concat(F.lit("code "), k.cast("string"))).alias("error"),
        F.concat(F.lit(LINK_PREFIX), media_id, F.lit("/")).alias("post_link"),
        F.to_date("ts").alias("date"),
        F.col("event_type"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as candidate posts."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")
    return d.select(
        F.col("doc_id").cast("string").alias("media_id"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("code"),
        (F.col("doc_id") % 150).alias("author_id"),
        F.col("text").alias("caption"),
        F.col("n_chars").alias("like_count"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 40).alias("comment_count"),
        F.array_distinct(words).alias("hashtags"),
        F.col("source").alias("search_tag"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(doc_id as int),0)").alias("taken_at"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("username"),
                    F.concat_ws(" ", "c_name", "c_mktsegment").alias("full_name"))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return ev.select(F.col("user_id").alias("follower_id"),
                     F.get_json_object("props", "$.k").cast("long").alias("followee_id")).distinct()


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    head = F.when(F.col("toxic") == 1, "Sensitive").otherwise("safe")
    return lb.select(F.col("doc_id").cast("string").alias("media_id"),
                     F.concat(head, F.lit("\n"), F.lit("quality "), F.col("quality").cast("string")).alias("verdict_text"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag lists per account from the logged tags, decorated to exercise every rule."""
    a = actions(spark, sf_dir).filter(F.col("hashtag").isNotNull())
    i = F.col("id")
    decorated = F.concat(F.when(i % 3 == 0, F.lit("#")).otherwise(F.lit("")),
                         F.when(i % 5 == 0, F.upper("hashtag")).otherwise(F.col("hashtag")))
    return a.select(
        F.col("account"),
        F.when(i % 4 == 0, F.lit("avoid")).otherwise(F.lit("hashtags")).alias("list_name"),
        i.alias("seq"),
        F.when(i % 11 == 0, F.lit("bad-tag")).otherwise(decorated).alias("raw"),
    )


def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag lists naming the posts' searched tags (``documents.source``)."""
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("#"), F.col("source"))).otherwise(F.col("source"))
    return d.select(F.concat(F.lit("acct"), (F.col("doc_id") % 7).cast("string")).alias("account"),
                    F.lit("hashtags").alias("list_name"), F.col("doc_id").alias("seq"), raw.alias("raw"))


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    return b.select(
        F.lit("reader").alias("user_id"),
        item.alias("position"),
        F.col("text").alias("title"),
        F.concat(F.lit("a"), (item % 7).cast("string")).alias("author"),
        F.concat(F.lit(BOOK_SITE + "/book/show/"), item.cast("string")).alias("book_url"),
        (item % 6).cast("int").alias("rating"),
        F.when(item % 3 == 0, F.lit(None)).otherwise(F.col("text")).alias("review"),
    )


def screen_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term table (kind keyword/avoid): of all words of each ``benchmark`` text the last in the alphabet."""
    b = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")
    kind = F.when(F.col("item_id") % 2 == 0, F.lit("avoid")).otherwise(F.lit("keyword"))
    return b.select(kind.alias("kind"), F.array_max(words).alias("term")).filter(F.col("term").isNotNull()).distinct()


def screening_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run parameters per account (caps, tag lists naming ``documents.source``) and its viewer id."""
    u = F.col("user_id")
    src = lambda n: F.concat(F.lit("src"), ((u + n) % 20).cast("string"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        u.cast("string").alias("account"), F.array(src(0), src(7), src(13)).alias("hashtags"),
        F.when(u % 3 == 0, F.array(F.lit("Que"), F.lit("DIE"))).alias("avoid_hashtags"),
        (u % 7).cast("int").alias("likes_per_day"), (u % 5).cast("int").alias("comments_per_day"),
        (u % 2 == 1).alias("allow_sensitive"), u.cast("long").alias("viewer_id"))


# fixed value: one shelf row as the shelf page renders it
SHELF_ROW_HTML = ('<tr id="review_%d"><td class="field title"><div class="value">'
                  '<a href="/book/show/%d">%s</a></div></td><td class="field author">'
                  '<div class="value"><a href="/author/%s">%s</a></div></td>'
                  '<td class="field rating"><div class="stars" data-rating="%s"></div></td>'
                  '<td class="field review"><div class="value">%s</div></td></tr>')


def shelf_pages(spark: SparkSession, sf_dir: str, per_page: int = 100) -> DataFrame:
    """Shelf pages rendered from ``part``: 100 rows per page in ``table#books``.

    Pages hold at most ``per_page`` rows by construction, so collecting a
    page's rows is bounded.
    """
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rating = F.when(key % 13 == 0, F.lit("x")).otherwise((F.col("p_size") % 6).cast("string"))
    review = F.when(key % 4 == 0, F.lit("")).otherwise(F.col("p_type"))
    row = F.format_string(SHELF_ROW_HTML, key, key, F.col("p_name"), F.col("p_brand"), F.col("p_brand"), rating, review)
    rows = p.select((key % 3).cast("string").alias("user_id"), key, row.alias("row_html"))
    # rank inside key ranges, plus a prefix of range counts: no window spans a user
    rows = bucketed_row_number(rows, ["user_id"], (key / 4096).cast("long"), ["p_partkey"], "_rank")
    rows = rows.withColumn("page", ((F.col("_rank") - 1) / per_page).cast("long") + 1)
    page = (rows.groupBy("user_id", "page")
            .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "row_html"))).alias("r")))
    html = F.concat(F.lit('<html><body><table id="books"><tbody>'),
                    F.array_join(F.transform("r", lambda s: s["row_html"]), ""),
                    F.lit("</tbody></table></body></html>"))
    return page.select("user_id", "page", html.alias("html"))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelf crawl outcomes from ``lineitem``: user, page number, row count.

    The user key has its final type before the window, so that the window, the
    crawl's aggregate and its join share one partitioning.
    """
    li = table(spark, sf_dir, "lineitem").withColumn("user_id", F.col("l_orderkey").cast("string"))
    w = Window.partitionBy("user_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select("user_id", F.row_number().over(w).cast("long").alias("page"), F.col("l_quantity").cast("int").alias("n_rows"))


def run_params_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings JSON text per account, some keys missing or unparsable."""
    ev = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    obj = F.struct(
        u.cast("string").alias("account"),
        F.array(F.concat(F.lit("tag"), (u % 20).cast("string")), F.concat(F.lit("tag"), ((u + 7) % 20).cast("string"))).alias("hashtags"),
        F.when(u % 2 == 0, F.array(F.concat(F.lit("tag"), ((u + 3) % 20).cast("string")))).alias("avoid_hashtags"),
        F.when(u % 7 == 0, F.lit("abc")).when(u % 5 == 0, F.lit(None)).otherwise((u % 60).cast("string")).alias("likes_per_day"),
        F.when(u % 3 == 0, F.lit(None)).otherwise((u % 20).cast("string")).alias("comments_per_day"),
        F.when(u % 4 == 0, F.lit(None)).otherwise(u % 2 == 1).alias("allow_sensitive"),
        F.when(u % 6 != 0, F.concat(F.lit("g"), u.cast("string"))).alias("goodreads_user_id"),
        F.lit("hunter2").alias("password"),
        F.lit("sk-none").alias("openai_api_key"),
    )
    return ev.select(F.to_json(obj).alias("value"))


def run_params_files(spark: SparkSession, sf_dir: str, per_file: int = 1000) -> DataFrame:
    """``(file, value)``: JSON arrays of the settings of ``per_file`` account ids each, so the collect is bounded."""
    j = run_params_json(spark, sf_dir)
    account = F.get_json_object("value", "$.account").cast("long")
    return (j.groupBy(F.floor(account / per_file).alias("file"))
            .agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("value")))


def shelf_json(spark: SparkSession, sf_dir: str, per_file: int = 100) -> DataFrame:
    """Bookshelf JSON arrays (as the shelf exporter writes them) from ``benchmark``.

    Each text holds at most ``per_file`` books, so the collect is bounded.
    """
    item = F.col("position")
    b = shelf(spark, sf_dir).select(
        "position",
        F.struct(F.when(item % 9 == 0, F.lit(None)).otherwise(F.col("title")).alias("title"),
                 F.when(item % 5 == 0, F.lit("")).otherwise(F.col("author")).alias("author"),
                 "book_url",
                 F.when(F.col("rating") == 0, F.lit(None)).otherwise(F.col("rating").cast("string")).alias("rating"),
                 "review").alias("book"))
    chunk = (F.col("position") / per_file).cast("long")
    g = (b.groupBy(chunk.alias("chunk"))
         .agg(F.array_sort(F.collect_list(F.struct("position", "book"))).alias("items")))
    return g.select(F.concat(F.lit("reader-"), F.col("chunk").cast("string")).alias("user_id"),
                    F.to_json(F.transform("items", lambda s: s["book"])).alias("value"))

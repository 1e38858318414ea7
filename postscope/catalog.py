"""Registry of query keys -> ``(spark, sf_dir) -> DataFrame`` over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import stats
from .sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _actions(spark, sf):
    return td.actions(spark, sf)


# ---- sources -------------------------------------------------------------

@query("actions_scan")
def q_actions_scan(spark, sf):
    from .session import scratch_path
    from .sources.actions import append_actions, read_actions
    path = scratch_path(spark, "log")
    append_actions(_actions(spark, sf), path)
    return _dated(read_actions(spark, path))


@query("actions_iso_scan")
def q_actions_iso_scan(spark, sf):
    """A log without a typed time: text stamps only, some without a fraction."""
    from .session import scratch_path
    from .sources.actions import read_actions_iso
    a = _actions(spark, sf)
    text = F.when(F.col("id") % 7 == 0, F.substring("timestamp", 1, 19)).otherwise(F.col("timestamp"))
    path = scratch_path(spark, "iso-log")
    a.withColumn("timestamp", text).drop("ts", "event_type").write.partitionBy("date").parquet(path)
    return read_actions_iso(spark, path).select("id", "timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                                                "account", "action_type", "media_id", "post_link")


def _dated(a):
    return a.select("id", "timestamp", "account", "action_type", "media_id", "hashtag", "comment",
                    "error", "post_link", F.date_format("date", "yyyy-MM-dd").alias("date"))


# ---- statistics ----------------------------------------------------------

@query("lookback")
def q_lookback(spark, sf):
    return stats.lookback(_actions(spark, sf), td.AS_OF).select("id", "timestamp", "action_type", "hashtag")


@query("tagged_actions")
def q_tagged(spark, sf):
    return stats.tagged(_actions(spark, sf)).select("id", "timestamp", "account", "action_type", "media_id", "hashtag")


@query("error_rows")
def q_error_rows(spark, sf):
    return stats.errors_only(_actions(spark, sf))


@query("type_counts")
def q_type_counts(spark, sf):
    return stats.type_counts(_actions(spark, sf))


@query("type_counts_total")
def q_type_counts_total(spark, sf):
    return stats.type_counts(_actions(spark, sf), total=True)


@query("headline")
def q_headline(spark, sf):
    return stats.headline(_actions(spark, sf))


@query("action_history")
def q_action_history(spark, sf):
    return stats.action_history(_actions(spark, sf), td.AS_OF)


@query("history_pivot")
def q_history_pivot(spark, sf):
    return stats.history_pivot(_actions(spark, sf), td.AS_OF)


@query("tag_stats")
def q_tag_stats(spark, sf):
    return stats.tag_stats(_actions(spark, sf))


@query("tag_pivot")
def q_tag_pivot(spark, sf):
    return stats.tag_pivot(_actions(spark, sf))


@query("top_tags")
def q_top_tags(spark, sf):
    return stats.top_tags(_actions(spark, sf))


@query("success_rate")
def q_success_rate(spark, sf):
    return stats.success_rate(_actions(spark, sf))


@query("tag_success")
def q_tag_success(spark, sf):
    return stats.tag_success(_actions(spark, sf))


@query("latest_errors")
def q_latest_errors(spark, sf):
    return stats.latest_errors(_actions(spark, sf))


# ---- storage round trips (S2, S3, U1) -------------------------------------

def _log_columns(df):
    return df.select("id", "timestamp", "account", "action_type", "media_id", "hashtag", "comment",
                     "error", "post_link")


@query("append_roundtrip")
def q_append_roundtrip(spark, sf):
    from .session import scratch_path
    from .sources.actions import append_actions, read_actions
    a = _actions(spark, sf)
    path = scratch_path(spark, "append")
    split = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    append_actions(a.filter(split), path)          # creates the log
    append_actions(a.filter(~split), path)         # appends to it
    back = read_actions(spark, path)
    return _log_columns(back)


@query("append_batches")
def q_append_batches(spark, sf):
    """Batches committed once: a repeated batch adds nothing, a day's batches are joined."""
    from .session import scratch_path
    from .sources.actions import append_actions, compact_day, read_actions
    a = _actions(spark, sf)
    path = scratch_path(spark, "append-batches")
    for n in range(3):
        append_actions(a.filter(F.col("id") % 3 == n), path, batch=f"run-{n}")
    compact_day(spark, path, "2024-01-15")
    append_actions(a.filter(F.col("id") % 3 == 1), path, batch="run-1")      # a retried run
    return _log_columns(read_actions(spark, path))


@query("evolved_union")
def q_evolved_union(spark, sf):
    from .sources.actions import union_evolved, v1_projection
    a = _actions(spark, sf)
    old = v1_projection(a.filter(F.col("id") % 2 == 0))
    new = a.filter(F.col("id") % 2 == 1)
    return _log_columns(union_evolved(old, new.select(*old.columns, "post_link")))


@query("evolved_scan")
def q_evolved_scan(spark, sf):
    from .session import scratch_path
    from .sources.actions import append_actions, read_actions, v1_projection, with_date
    a = _actions(spark, sf)
    path = scratch_path(spark, "evolve")
    old = v1_projection(a.filter(F.col("id") % 2 == 0))
    with_date(old).write.mode("append").partitionBy("date").parquet(path)   # first schema version
    append_actions(a.filter(F.col("id") % 2 == 1), path)                     # after the migration
    return _log_columns(read_actions(spark, path))


# ---- tag lists (F1, F2, W1, W2, P11, A13) -----------------------------------

def _tag_lists(spark, sf):
    from .operators import tags as T
    return T.admitted(td.tags(spark, sf), T.TAG_CAP)


@query("normalize_tags")
def q_normalize_tags(spark, sf):
    from .operators import tags as T
    return T.normalize_tags(td.tags(spark, sf)).select("account", "list_name", "seq", "raw", "tag", "valid")


@query("dedupe_tags")
def q_dedupe_tags(spark, sf):
    from .operators import tags as T
    return T.dedupe_tags(td.tags(spark, sf))


@query("admit_tags")
def q_admit_tags(spark, sf):
    from .operators import tags as T
    return T.admit_tags(td.tags(spark, sf), T.TAG_CAP)


@query("admit_tags_cap5")
def q_admit_tags_cap5(spark, sf):
    from .operators import tags as T
    return T.admit_tags(td.tags(spark, sf), 5)


@query("remove_tags")
def q_remove_tags(spark, sf):
    from .operators import tags as T
    from .session import scratch_path
    path = scratch_path(spark, "tag-lists")
    _tag_lists(spark, sf).write.parquet(path)      # the stored lists that removals act on
    lists = spark.read.parquet(path)
    removals = lists.filter(F.lower("tag").isin("tag3", "tag7")).select("account", "list_name", "tag")
    clears = lists.filter((F.col("account").cast("long") % 10 == 0) & (F.col("list_name") == "avoid"))
    return T.remove_tags(lists, removals, clears)


@query("tag_list_size")
def q_tag_list_size(spark, sf):
    from .operators import tags as T
    return T.tag_list_size(_tag_lists(spark, sf))


# ---- screening (P4-P9, J1, J1b, J5, J6, W4, A10) -----------------------------

# fixed fixture parameters (FIXTURES.md): terms that occur in the documents,
# an avoid list that hits, the viewer account
FIX_TERMS = ("license", "token")
FIX_AVOID = ("que", "dieser", "whated")


def _posts(spark, sf):
    return td.posts(spark, sf)


@query("keyword_screen")
def q_keyword_screen(spark, sf):
    from .operators import screening as S
    return S.keyword_screen(_posts(spark, sf), FIX_TERMS).select("media_id", "kw_hit")


@query("avoid_screen")
def q_avoid_screen(spark, sf):
    from .operators import screening as S
    return S.avoid_screen(_posts(spark, sf), FIX_AVOID).select("media_id", "avoid_hit")


@query("own_posts")
def q_own_posts(spark, sf):
    from .operators import screening as S
    return S.own_post(_posts(spark, sf), td.VIEWER_ID).select("media_id", "own_post")


@query("verdict_parse")
def q_verdict_parse(spark, sf):
    from .operators import screening as S
    return S.parse_verdict(td.verdicts(spark, sf)).select("media_id", "sensitive", "description")


@query("safety_gate")
def q_safety_gate(spark, sf):
    from .operators import screening as S
    return S.safety_gate(_posts(spark, sf), td.verdicts(spark, sf), allow_sensitive=False).select("media_id")


def _decisions(spark, sf):
    from .operators import screening as S
    return S.decide(_posts(spark, sf), _actions(spark, sf), td.verdicts(spark, sf), td.VIEWER_ID,
                    terms=FIX_TERMS, avoid=FIX_AVOID, allow_sensitive=False, account=str(td.VIEWER_ID))


@query("decisions")
def q_decisions(spark, sf):
    return _decisions(spark, sf)


@query("funnel")
def q_funnel(spark, sf):
    from .operators import screening as S
    return S.funnel(_decisions(spark, sf))


def _likes(spark, sf):
    return _actions(spark, sf).filter(F.col("action_type") == "like").select("id", "account", "media_id")


@query("not_yet_commented")
def q_not_yet_commented(spark, sf):
    from .operators import screening as S
    return S.not_yet(_likes(spark, sf), _actions(spark, sf), "comment")


@query("already_commented")
def q_already_commented(spark, sf):
    from .operators import screening as S
    return S.already(_likes(spark, sf), _actions(spark, sf), "comment")


@query("not_yet_indexed")
def q_not_yet_indexed(spark, sf):
    """The history test against a log that is bucketed by account and post."""
    import uuid

    from .operators import screening as S
    from .session import scratch_path
    from .sources.actions import save_history
    name = f"history_{uuid.uuid4().hex[:12]}"
    log = save_history(_actions(spark, sf), name, buckets=16, path=scratch_path(spark, name))
    return S.not_yet(_likes(spark, sf), log, "comment")


@query("screen_by_table")
def q_screen_by_table(spark, sf):
    from .operators import screening as S
    return S.screen_by_table(_posts(spark, sf), td.screen_terms(spark, sf))


@query("screening_run")
def q_screening_run(spark, sf):
    from .plans.flows import screening_run
    p = td.screening_params(spark, sf)
    return screening_run(p.drop("viewer_id"), _posts(spark, sf), _actions(spark, sf), td.verdicts(spark, sf),
                         p.select("account", "viewer_id"), terms=FIX_TERMS).select(
        "account", "action_type", "media_id", "search_tag", F.col("seq").cast("long").alias("seq"), F.col("rn").cast("long").alias("rn"))


@query("recent_per_tag")
def q_recent_per_tag(spark, sf):
    from .operators import screening as S
    return S.recent_per_tag(_posts(spark, sf)).select("media_id", "search_tag", F.col("rn").cast("long").alias("rn"))


@query("candidates")
def q_candidates(spark, sf):
    from .operators import screening as S
    from .operators import tags as T
    lists = T.admitted(td.source_tags(spark, sf))
    return S.candidates(lists, _posts(spark, sf)).select("account", "seq", "search_tag", "media_id")


# ---- quota and audits (W3, W6, W7, P12, P13, A12, O5) ------------------------

FIX_TZ = "America/Argentina/Buenos_Aires"


def _quota_cands(spark, sf):
    from .operators.quota import with_history
    a = _actions(spark, sf)
    start = F.lit(td.HISTORY_BEFORE).cast("timestamp_ntz")
    done = a.filter((F.col("ts") < start) & (F.col("event_type") != "error"))
    cands = (a.filter(F.col("ts") >= start)
             .select("id", "ts", "account", F.date_format("date", "yyyy-MM-dd").alias("date"), "media_id",
                     (F.col("event_type") != "error").alias("ok")))
    return with_history(cands, done)


@query("quota")
def q_quota(spark, sf):
    from .operators.quota import quota_over_days
    out = quota_over_days(_quota_cands(spark, sf), cap=2, run=["account"], day="date")
    return out.select("id", "account", "date", "media_id", "attempted", "accepted")


@query("quota_audit")
def q_quota_audit(spark, sf):
    from .operators.audits import quota_audit
    a = _actions(spark, sf)
    return quota_audit(a, 2).select("id", "account", F.date_format("date", "yyyy-MM-dd").alias("date"), "action_type")


@query("gap_audit")
def q_gap_audit(spark, sf):
    from .operators.audits import gap_audit
    return gap_audit(_actions(spark, sf)).select("id", "account", "gap_us", "too_close")


@query("active_hours")
def q_active_hours(spark, sf):
    from .operators.audits import active_hours
    return active_hours(_actions(spark, sf), tz=FIX_TZ).select("id", F.col("local_hour").cast("long").alias("local_hour"))


@query("hour_profile")
def q_hour_profile(spark, sf):
    from .operators.audits import hour_profile
    return hour_profile(_actions(spark, sf), tz=FIX_TZ).select(F.col("hour").cast("long").alias("hour"), "count")


@query("hash_sample")
def q_hash_sample(spark, sf):
    from .operators.audits import hash_sample
    return hash_sample(_actions(spark, sf), "id", 10, 7).select("id", "account", "action_type")


@query("seeded_order")
def q_seeded_order(spark, sf):
    from .operators.audits import seeded_order
    return seeded_order(_actions(spark, sf).select("id", "account"), "id", 7)


# ---- enrichment (J2-J4, F6, F9-F15) -----------------------------------------

@query("post_details")
def q_post_details(spark, sf):
    from .operators.enrich import with_author
    d = with_author(_posts(spark, sf), td.authors(spark, sf))
    return d.select("media_id", "username", "full_name", "caption", "like_count", "comment_count")


@query("following_flag")
def q_following_flag(spark, sf):
    from .operators.enrich import with_following
    return with_following(_posts(spark, sf), td.follows(spark, sf), td.VIEWER_ID).select("media_id", "author_id", "is_following")


@query("title_match")
def q_title_match(spark, sf):
    from .operators.enrich import title_match
    return title_match(_posts(spark, sf), td.shelf(spark, sf)).select("media_id", "position", "book_title", "book_rating", "book_review")


def _shelves(spark, sf):
    """Two readers' shelves whose positions overlap."""
    b = td.shelf(spark, sf)
    half = F.col("position") % 2
    return b.withColumn("user_id", F.concat(F.lit("reader"), half.cast("string"))).withColumn("position", F.floor(F.col("position") / 2).cast("long"))


@query("title_match_by_reader")
def q_title_match_by_reader(spark, sf):
    from .operators.enrich import title_match
    posts = _posts(spark, sf).withColumn("owner", F.concat(F.lit("reader"), (F.col("author_id") % 2).cast("string")))
    return (title_match(posts, _shelves(spark, sf), reader="owner")
            .select("media_id", "user_id", "position", "book_title", "book_rating", "book_review"))


@query("post_links")
def q_post_links(spark, sf):
    from .operators.enrich import links
    return links(_posts(spark, sf), td.LINK_PREFIX)


@query("shelf_excerpt")
def q_shelf_excerpt(spark, sf):
    from .operators.enrich import book_features
    return book_features(td.shelf(spark, sf)).select("position", "book_rating", "book_review")


@query("detect_language")
def q_detect_language(spark, sf):
    from .functions.language import detect_languages
    return detect_languages(_posts(spark, sf), "media_id", "caption")


@query("language_profiles")
def q_language_profiles(spark, sf):
    from .functions.profiles import learn_profiles
    return learn_profiles(td.table(spark, sf, "documents"))


@query("detect_language_by_profile")
def q_detect_language_by_profile(spark, sf):
    from .functions.profiles import detect_by_profile, learn_profiles
    return detect_by_profile(_posts(spark, sf), learn_profiles(td.table(spark, sf, "documents")))


@query("language_agreement")
def q_language_agreement(spark, sf):
    # short texts: every document cut at its sentences and lines; a fifth of the documents teaches nothing
    from .functions.language import LANG_ORDER, with_language
    from .functions.profiles import detect_by_profile, learn_profiles
    from .plans.ranking import spread
    held_out = F.col("doc_id") % 5 == 0
    docs = td.table(spark, sf, "documents").select("doc_id", "text", "lang")
    pieces = (spread(docs, "doc_id").select("doc_id", F.col("lang").alias("label"), F.posexplode(F.split("text", r"[.!?\n]")).alias("pos", "piece"))
              .filter(F.col("label").isin(LANG_ORDER) & F.col("piece").rlike(r"\p{L}")))
    found = detect_by_profile(with_language(pieces, "piece", "by_words"), learn_profiles(docs.filter(~held_out)),
                              ["doc_id", "pos", "label", "by_words"], "piece")
    return (found.groupBy("label", held_out.alias("held_out"))
            .agg(F.count("*").alias("n_pieces"), F.count_if(F.col("lang") == F.col("label")).alias("right_by_profile"),
                 F.count_if(F.col("by_words") == F.col("label")).alias("right_by_words")))


@query("post_features_by_profile")
def q_post_features_by_profile(spark, sf):
    from .functions.profiles import learn_profiles
    from .operators.enrich import post_features
    return post_features(_posts(spark, sf), td.authors(spark, sf), td.follows(spark, sf), td.shelf(spark, sf), td.VIEWER_ID,
                         profiles=learn_profiles(td.table(spark, sf, "documents")))


@query("post_brief")
def q_post_brief(spark, sf):
    from .operators.enrich import post_brief, with_author
    return post_brief(with_author(_posts(spark, sf), td.authors(spark, sf)))


@query("post_features")
def q_post_features(spark, sf):
    from .operators.enrich import post_features
    return post_features(_posts(spark, sf), td.authors(spark, sf), td.follows(spark, sf), td.shelf(spark, sf), td.VIEWER_ID)


# ---- extraction and files (S4-S8, W5, P10) ------------------------------------

@query("shelf_extract")
def q_shelf_extract(spark, sf):
    from .sources.html import extract_shelf
    return extract_shelf(td.shelf_pages(spark, sf), site=td.BOOK_SITE)


@query("page_links")
def q_page_links(spark, sf):
    from .sources.html import extract_links
    return extract_links(td.table(spark, sf, "pages")).withColumn("pos", F.col("pos").cast("long"))


@query("page_elements")
def q_page_elements(spark, sf):
    from .sources.html import ElementSpec, extract_elements
    return (extract_elements(td.table(spark, sf, "pages"), ElementSpec("a", ("href",))).filter("error is null")
            .select("page_id", "pos", "href", "text"))


@query("shelf_crawl")
def q_shelf_crawl(spark, sf):
    from .operators.crawl import crawl_shelf
    # one page in ten is short of rows: the crawl ends there
    pages = td.shelf_pages(spark, sf, per_page=50)
    broken = F.when(F.col("page") % 10 == 0, F.lit("<html><p>busy")).otherwise(F.col("html"))
    return crawl_shelf(pages.withColumn("html", broken), site=td.BOOK_SITE, per_page=50)


@query("crawl_prefix")
def q_crawl_prefix(spark, sf):
    from .operators.crawl import crawl_prefix
    return crawl_prefix(td.crawl_pages(spark, sf), per_page=25)


def _shelf_files(spark, sf):
    """Shelf JSON written as one file per reader, then read back."""
    from .session import scratch_path
    from .sources.jsonfiles import read_shelf_json
    path = scratch_path(spark, "shelf-json")
    td.shelf_json(spark, sf).select("value", "user_id").write.partitionBy("user_id").text(path)
    return read_shelf_json(spark, path)


@query("shelf_json")
def q_shelf_json(spark, sf):
    return _shelf_files(spark, sf)


@query("complete_books")
def q_complete_books(spark, sf):
    from .operators.enrich import complete_books
    return complete_books(_shelf_files(spark, sf))


@query("run_params")
def q_run_params(spark, sf):
    from .session import scratch_path
    from .sources.jsonfiles import read_run_params
    path = scratch_path(spark, "run-params")
    # a file per thousand account ids: a file system spends milliseconds on each file, whatever it holds
    td.run_params_files(spark, sf).write.partitionBy("file").text(path)
    p = read_run_params(spark, path)
    return p.select("account", F.array_join("hashtags", ",").alias("hashtags"),
                    F.array_join("avoid_hashtags", ",").alias("avoid_hashtags"),
                    "likes_per_day", "comments_per_day", "allow_sensitive", "shelf_user_id")


@query("run_log_parse")
def q_run_log_parse(spark, sf):
    from .session import scratch_path
    from .sources.runlog import read_run_log, render_action_lines
    path = scratch_path(spark, "run-log")
    render_action_lines(_actions(spark, sf)).select("value").write.text(path)
    return read_run_log(spark, path).drop("file", "record")


# ---- streaming (T1-T3) and the classifier hook (X1) ---------------------------

def _stream_actions(spark, sf):
    return td.actions_from_events(td.events_stream(spark, sf))


@query("stream_daily_counts")
def q_stream_daily_counts(spark, sf):
    from .streaming.actions import stream_daily_counts, stream_paths
    return stream_daily_counts(_stream_actions(spark, sf), *stream_paths(spark, "daily-counts"), delay_days=16)


@query("stream_late_rows")
def q_stream_late_rows(spark, sf):
    """Rows that came behind a watermark of one day (``late`` of T1)."""
    from .streaming.actions import DailyCounts, stream_paths
    path, checkpoint = stream_paths(spark, "late-rows")
    job = DailyCounts(spark, path, delay_days=1).drain(_stream_actions(spark, sf), checkpoint)
    return job.late().select("id", "action_type").distinct()


@query("stream_first_action")
def q_stream_first_action(spark, sf):
    from .streaming.actions import stream_first_action, stream_paths
    start = F.lit(td.HISTORY_BEFORE).cast("timestamp_ntz")
    s = _stream_actions(spark, sf).filter(F.col("ts") >= start)
    history = _actions(spark, sf).filter(F.col("ts") < start)
    first = stream_first_action(s.select("id", "ts", "account", "media_id", "action_type"),
                                *stream_paths(spark, "first-action"), history)
    return first.select("account", "media_id", "action_type", "id")


@query("stream_quota")
def q_stream_quota(spark, sf):
    from .streaming.actions import stream_paths, stream_quota
    start = F.lit(td.HISTORY_BEFORE).cast("timestamp_ntz")
    s = (_stream_actions(spark, sf).filter(F.col("ts") >= start)
         .select("id", "ts", "account", F.date_format("date", "yyyy-MM-dd").alias("date"), "media_id",
                 (F.col("event_type") != "error").alias("ok")))
    history = _actions(spark, sf).filter((F.col("ts") < start) & (F.col("event_type") != "error"))
    acc = stream_quota(s, *stream_paths(spark, "quota"), cap=2, by=["account", "date"], history=history, delay_days=16)
    return acc.select("id", "account", "date", "media_id")


def review_brief(rec: dict):
    """The demo classifier: skip short captions, refuse captions with an
    e-mail address (personal data), else a short factual tag."""
    caption = rec.get("caption") or ""
    if len(caption) < 50:
        return None
    if "@" in caption:
        raise ValueError("personal data in caption")
    return f"{rec.get('username')}:{len(caption)}"


@query("classifier_hook")
def q_classifier_hook(spark, sf):
    from .operators.classifier import with_classifier
    from .operators.enrich import with_author
    d = with_author(_posts(spark, sf), td.authors(spark, sf))
    return with_classifier(d, review_brief, ["caption", "username"]).select("media_id", "result", "skipped", "error")


@query("classify_once")
def q_classify_once(spark, sf):
    """The hook with stored results: a first run over a part of the posts, then one over all of them."""
    from .operators.classifier import classify_once
    from .operators.enrich import with_author
    from .session import scratch_path
    d = with_author(_posts(spark, sf), td.authors(spark, sf))
    store = scratch_path(spark, "classified")
    classify_once(d.filter(F.col("like_count") % 2 == 0), review_brief, ["caption", "username"], store, "brief-1")
    return (classify_once(d, review_brief, ["caption", "username"], store, "brief-1")
            .select("media_id", "result", "skipped", "error"))

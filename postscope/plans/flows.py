"""The reference's two end-to-end flows as single Spark jobs.

* ``statistics_view`` is the statistics window: the 7-day history pivot, the
  tag ranking and the success rate, each a small aggregate the caller may
  ``toPandas()``.
* ``screening_run`` is one screening run for many accounts at once: each
  account's listed tags meet the newest posts per tag, posts get their
  screens and decision (account-level avoid list, history and own-post
  tests), and per-account quotas pick what would be attempted.  Outcomes
  are not known before acting, so every attempt counts as a success (the
  audit reading of a run); real outcomes go through ``operators.quota`` with
  an ``ok`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import screening as S
from ..operators import stats


def statistics_view(actions: DataFrame, as_of: str, days: int = stats.DEFAULT_DAYS,
                    top: int = stats.TOP_TAGS) -> dict[str, DataFrame]:
    return {
        "history": stats.history_pivot(actions, as_of, days),
        "top_tags": stats.top_tags(actions, top),
        "success": stats.success_rate(actions),
    }


def screening_run(params: DataFrame, posts: DataFrame, actions: DataFrame, verdicts: DataFrame | None,
                  viewers: DataFrame, terms: Sequence[str] = S.KEYWORDS,
                  per_tag: int = S.RECENT_PER_TAG) -> DataFrame:
    """Planned ``like``/``comment`` actions of one run for every account.

    ``params``: ``account, hashtags, avoid_hashtags, likes_per_day,
    comments_per_day, allow_sensitive`` (S5); ``viewers``: ``account,
    viewer_id``.  The walk order is the tag list order, then newest post
    first.  Output: ``account, action_type, media_id, search_tag, seq, rn``.
    """
    lists = params.select("account", F.lit("hashtags").alias("list_name"),
                          F.posexplode("hashtags").alias("seq", "tag"))
    # only the newest posts of a tag are walked: screen these, not all posts
    posts = S.recent_per_tag(posts, per_tag).drop("rn")
    cands = S.candidates(lists, posts, per_tag)                      # J6 + W4, per account
    walk = cands.select("account", "seq", "search_tag", "media_id", "author_id", "rn")

    # post-level screens (independent of the account)
    kw = S.keyword_screen(posts.select("media_id", "caption", "hashtags", "search_tag"), terms) \
        .select("media_id", "kw_hit")
    walk = walk.join(kw, "media_id", "left")
    if verdicts is not None:
        walk = walk.join(S.sensitivity(verdicts), "media_id", "left")
    else:
        walk = walk.withColumn("sensitive", F.lit(False))

    # account-level screens: avoid list, history per type, own post
    empty = F.array().cast("array<string>")
    avoid = params.select("account", F.explode(F.transform(F.coalesce("avoid_hashtags", empty), F.lower)).alias("_tag"))
    post_tags = posts.select("media_id", F.explode(F.transform(F.coalesce("hashtags", empty), F.lower)).alias("_tag"))
    avoid_hit = (walk.select("account", "media_id").distinct().join(post_tags, "media_id", "inner")
                 .join(avoid.distinct(), ["account", "_tag"], "left_semi")
                 .select("account", "media_id").distinct().withColumn("avoid_hit", F.lit(True)))
    # like and comment history in one conditional aggregate per (account, post)
    kind = F.col("action_type")
    done = (actions.filter(kind.isin("like", "comment") & F.col("media_id").isNotNull())
            .groupBy("account", F.col("media_id").cast("string").alias("media_id"))
            .agg(F.max(kind == "like").alias("liked"), F.max(kind == "comment").alias("commented")))
    walk = (walk.join(avoid_hit, ["account", "media_id"], "left")
            .join(done, ["account", "media_id"], "left")
            .join(viewers.select("account", "viewer_id"), "account", "left")
            .join(params.select("account", "likes_per_day", "comments_per_day", "allow_sensitive"), "account", "left"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (F.when(flag("kw_hit"), "keyword").when(flag("avoid_hit"), "avoid_tag")
              .when(flag("commented"), "already_done")
              .when(F.coalesce(F.col("author_id") == F.col("viewer_id"), F.lit(False)), "own_post")
              .when(flag("sensitive") & ~F.coalesce("allow_sensitive", F.lit(True)), "sensitive")
              .otherwise("ok"))
    walk = walk.withColumn("like_eligible", ~flag("liked")).withColumn("comment_eligible", reason == "ok")

    # per-account caps: an account walks its own tags times ``per_tag`` posts, so
    # its first occurrences are few; the cap is a column of the account
    out = None
    for action, eligible, cap_col in (("like", "like_eligible", "likes_per_day"),
                                      ("comment", "comment_eligible", "comments_per_day")):
        first = (walk.filter(F.col(eligible)).groupBy("account", "media_id")
                 .agg(F.min(F.struct("seq", "rn", "search_tag")).alias("_at"), F.first(cap_col).alias("_cap")))
        n = F.row_number().over(Window.partitionBy("account").orderBy("_at.seq", "_at.rn", "media_id"))
        picked = (first.withColumn("_n", n).filter(F.col("_n") <= F.col("_cap"))
                  .select("account", F.lit(action).alias("action_type"), "media_id", "_at.search_tag", "_at.seq", "_at.rn"))
        out = picked if out is None else out.unionByName(picked)
    return out

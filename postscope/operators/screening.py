"""Screening of candidate posts: P4-P9, J1/J1b, J5, J6, W4, A10.

Like and comment eligibility are separate flags: keyword and avoid hits,
own posts and sensitive verdicts block comments only; a like is blocked
only by an earlier like of the same post (and then by the quota, W3).
History tests are anti/semi joins against the de-duplicated ids of the
log (one build row per id, so a hot post id cannot skew the join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..plans.ranking import top_n_per_group
from .substring_join import matches

# fixed value: the word that marks a giveaway post
KEYWORDS = ("giveaway",)
# fixed value: posts fetched per searched tag
RECENT_PER_TAG = 10
SEP = "\u0000"   # cannot occur in a term, so joined texts never create false hits

REASONS = ("keyword", "avoid_tag", "already_done", "own_post", "sensitive", "ok")


def screen_text(posts: DataFrame) -> Column:
    """Folded caption, post tags and searched tag joined by NUL."""
    tags = F.array_join(F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), F.lower), SEP)
    return F.concat_ws(SEP, F.lower(F.coalesce("caption", F.lit(""))), tags,
                       F.lower(F.coalesce("search_tag", F.lit(""))))


def _contains(term: str):
    return lambda x: F.lower(x).contains(term)


def keyword_screen(posts: DataFrame, terms: Sequence[str] = KEYWORDS) -> DataFrame:
    """``kw_hit`` when a term is a substring of the caption, a post tag or the searched tag."""
    caption = F.lower(F.coalesce("caption", F.lit("")))
    search = F.lower(F.coalesce("search_tag", F.lit("")))
    tags = F.coalesce("hashtags", F.array().cast("array<string>"))
    hit = F.lit(False)
    for term in (t.lower() for t in terms):
        hit = hit | caption.contains(term) | search.contains(term) | F.exists(tags, _contains(term))
    return posts.withColumn("kw_hit", hit)


def avoid_screen(posts: DataFrame, avoid: Sequence[str]) -> DataFrame:
    """P5: ``avoid_hit`` when a post tag equals an avoid tag, case-insensitively."""
    folded = F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), F.lower)
    avoid_l = sorted({a.lower() for a in avoid})
    hit = F.coalesce(F.arrays_overlap(folded, F.array(*[F.lit(a) for a in avoid_l])), F.lit(False)) \
        if avoid_l else F.lit(False)
    return posts.withColumn("avoid_hit", hit)


def own_post(posts: DataFrame, viewer_id) -> DataFrame:
    """The viewer's own posts."""
    return posts.withColumn("own_post", F.coalesce(F.col("author_id") == F.lit(viewer_id), F.lit(False)))


def parse_verdict(verdicts: DataFrame, col: str = "verdict_text") -> DataFrame:
    """``sensitive`` (first line starts with 'sensitive') and ``description``
    (everything after the first line break, stripped)."""
    v = ustrip(F.coalesce(F.col(col), F.lit("")))
    rest = F.regexp_extract(v, r"(?s)^[^\n]*\n(.*)$", 1)
    return verdicts.withColumn("sensitive", F.lower(v).startswith("sensitive")) \
                   .withColumn("description", ustrip(rest))


def sensitivity(verdicts: DataFrame) -> DataFrame:
    """One row per post: sensitive when any of its verdicts says so."""
    return (parse_verdict(verdicts).groupBy("media_id")
            .agg(F.max(F.col("sensitive").cast("int")).cast("boolean").alias("sensitive")))


def with_sensitivity(posts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Posts without a verdict are not sensitive."""
    return (posts.join(sensitivity(verdicts), "media_id", "left")
            .withColumn("sensitive", F.coalesce("sensitive", F.lit(False))))


def safety_gate(posts: DataFrame, verdicts: DataFrame, allow_sensitive: bool = True) -> DataFrame:
    """Drop sensitive posts unless allowed."""
    if allow_sensitive:
        return posts
    return with_sensitivity(posts, verdicts).filter(~F.col("sensitive")).drop("sensitive")


def _done(actions: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Logged rows of the given types with a post id (as text), under private key names."""
    return (actions.filter(F.col("action_type").isin(*kinds) & F.col("media_id").isNotNull())
            .select(*[F.col(c).cast("string").alias(f"_h_{c}") for c in (*by, "media_id")], "action_type"))


def _same_post(posts: DataFrame, done: DataFrame, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in (*by, "media_id"):
        cond = cond & (posts[c].cast("string") == done[f"_h_{c}"])
    return cond


def not_yet(posts: DataFrame, actions: DataFrame, action_type: str, by: Sequence[str] = ("account",)) -> DataFrame:
    """Posts without ``action_type`` in the log of the same ``by`` (ids compared as text).

    The log is one per account, so another account's action never counts;
    ``by=()`` compares the post alone, for a log of one account.
    """
    done = _done(actions, by, [action_type]).drop("action_type").distinct()
    return posts.join(done, _same_post(posts, done, by), "left_anti")


def already(posts: DataFrame, actions: DataFrame, action_type: str, by: Sequence[str] = ("account",)) -> DataFrame:
    """Posts that do have ``action_type`` in the log of the same ``by``."""
    done = _done(actions, by, [action_type]).drop("action_type").distinct()
    return posts.join(done, _same_post(posts, done, by), "left_semi")


def done_flags(posts: DataFrame, actions: DataFrame, flags: dict[str, str],
               by: Sequence[str] = ("account",)) -> DataFrame:
    """J1b flag form for several action types in one pass over the log.

    ``flags`` maps an action type to its output column.  The log is reduced to
    the candidates' posts by a semi join, then one conditional aggregate per
    (``by``, post) (partial, so a hot id is combined map-side) joins back once.
    """
    log = _done(actions, by, list(flags))
    keys = [f"_h_{c}" for c in (*by, "media_id")]
    wanted = posts.select(*[F.col(c).cast("string").alias(f"_h_{c}") for c in (*by, "media_id")]).distinct()
    ids = (log.join(wanted, keys, "left_semi").groupBy(*keys)
           .agg(*[F.max(F.col("action_type") == t).alias(out) for t, out in flags.items()]))
    out = posts.join(ids, _same_post(posts, ids, by), "left").drop(*keys)
    for o in flags.values():
        out = out.withColumn(o, F.coalesce(o, F.lit(False)))
    return out


def decide(posts: DataFrame, actions: DataFrame, verdicts: DataFrame | None, viewer_id,
           terms: Sequence[str] = KEYWORDS, avoid: Sequence[str] = (),
           allow_sensitive: bool = True, account: str | None = None) -> DataFrame:
    """One row per post with ``like_eligible``, ``comment_eligible`` and the
    first matching ``reason`` in the reference's test order.

    ``account`` selects the viewer's own log; without it the log is taken to be
    of one account.
    """
    if account is not None:
        actions = actions.filter(F.col("account") == account)
    d = keyword_screen(posts, terms)
    d = avoid_screen(d, avoid)
    d = own_post(d, viewer_id)
    d = done_flags(d, actions, {"like": "liked", "comment": "commented"}, by=())
    if verdicts is not None:
        d = with_sensitivity(d, verdicts)
    else:
        d = d.withColumn("sensitive", F.lit(False))
    blocked_sensitive = F.col("sensitive") & F.lit(not allow_sensitive)
    reason = (F.when(F.col("kw_hit"), "keyword")
              .when(F.col("avoid_hit"), "avoid_tag")
              .when(F.col("commented"), "already_done")
              .when(F.col("own_post"), "own_post")
              .when(blocked_sensitive, "sensitive")
              .otherwise("ok"))
    return d.select("media_id", "search_tag", (~F.col("liked")).alias("like_eligible"),
                    (reason == "ok").alias("comment_eligible"), reason.alias("reason"))


def funnel(decisions: DataFrame) -> DataFrame:
    """A10: posts per searched tag and reason."""
    return decisions.groupBy("search_tag", "reason").agg(F.count(F.lit(1)).alias("count"))


def screen_by_table(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """Screens driven by a term table ``(kind in keyword/avoid, term)``.

    Both screens are one substring join of the NUL-joined screen text: a keyword
    is a pattern as it is; an avoid term must be a whole post tag, and those
    alone stand between two NULs, so its pattern has one at either end.  No tag
    is exploded.  Empty terms match nothing.
    """
    t = terms.select("kind", F.lower("term").alias("term")).filter(F.col("term") != "").distinct()
    pats = t.select("kind", F.when(F.col("kind") == "avoid", F.concat(F.lit(SEP), "term", F.lit(SEP)))
                    .otherwise(F.col("term")).alias("_pat"))
    hits = matches(posts.select("media_id", screen_text(posts).alias("_s")), ["media_id"], "_s", pats, ["kind"], "_pat")

    def hit(kind: str) -> Column:
        return F.coalesce(F.exists("matched", lambda m: m["kind"] == kind), F.lit(False)).alias("kw_hit" if kind == "keyword" else "avoid_hit")
    return posts.select("media_id").join(hits, "media_id", "left").select("media_id", hit("keyword"), hit("avoid"))


def recent_per_tag(posts: DataFrame, n: int = RECENT_PER_TAG) -> DataFrame:
    """Newest ``n`` posts per searched tag (ties: media id), map-side limited."""
    return top_n_per_group(posts, ["search_tag"], [F.desc("taken_at"), F.col("media_id")], n, "rn")


def candidates(tag_lists: DataFrame, posts: DataFrame, n: int = RECENT_PER_TAG) -> DataFrame:
    """J6 + W4: each tag of the ``hashtags`` lists meets the newest ``n`` posts searched under it.

    The per-tag limit runs before the join, so the join sees at most ``n``
    posts per tag whatever the tag's volume.
    """
    recent = recent_per_tag(posts, n)
    tl = tag_lists.filter(F.col("list_name") == "hashtags").select("account", "list_name", "seq", ustrip("tag").alias("search_tag"))
    return tl.join(recent, "search_tag", "inner")

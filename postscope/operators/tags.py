"""Tag-list hygiene: F1/F2 normalise and validate, W1 dedupe, W2 admit with
a cap, P11 removals, A13 list sizes.

The reference builds each list one entry at a time.  The same outcome as a
set computation: a valid entry is ``duplicate`` when its case-folded key
already occurred earlier in the list, and ``too_many`` when its key's first
occurrence is not among the list's first ``cap`` distinct keys.  A repeat of
a key refused for the cap is therefore ``too_many`` too.

Plan: first occurrences are a partial aggregate per (list, key) (a hot key
is combined map-side); the cap-th first occurrence per list is a map-side
limited rank; both join back on their keys.  No window spans a whole list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_tag, valid_tag
from ..plans.ranking import kth_per_group

# fixed value: entries per list
TAG_CAP = 30
LIST_KEY = ["account", "list_name"]


def normalize_tags(tags: DataFrame) -> DataFrame:
    """add ``tag`` (normalised), ``key`` (folded) and ``valid``."""
    tag = normalize_tag("raw")
    return (tags.withColumn("tag", tag)
            # never null, so a join on it adds no null filter to one branch
            # only and the per-key aggregate's exchange is shared
            .withColumn("key", F.coalesce(F.lower("tag"), F.lit("")))
            .withColumn("valid", (F.col("tag") != "") & valid_tag("tag")))


def _first_seen(norm: DataFrame) -> DataFrame:
    """First position of each valid key.

    A conditional aggregate, not ``filter(valid)`` + ``min``: a filter on a
    derived column is pushed below the projection and re-evaluates the whole
    derivation per conjunct, outside codegen's common-subexpression reuse.
    """
    return (norm.groupBy(*LIST_KEY, "key")
            .agg(F.min(F.when(F.col("valid"), F.col("seq"))).alias("first_seq"))
            .filter(F.col("first_seq").isNotNull()))


def admit_tags(tags: DataFrame, cap: int = TAG_CAP) -> DataFrame:
    """Status per entry in ``ok, empty, invalid, duplicate, too_many``.

    The cap threshold joins the per-key table (one row per list and key), so
    the entries meet a single join; both uses of the per-key aggregate share
    one exchange, and the log is scanned twice.
    """
    norm = normalize_tags(tags)
    first = _first_seen(norm)
    if cap >= 1:
        kth = kth_per_group(first, LIST_KEY, ["first_seq"], cap)
        first = first.join(kth, LIST_KEY, "left").select(
            *LIST_KEY, "key", "first_seq",
            (F.col("kth_first_seq").isNotNull() & (F.col("first_seq") > F.col("kth_first_seq"))).alias("_over"))
    else:
        first = first.withColumn("_over", F.lit(True))
    out = norm.join(first, [*LIST_KEY, "key"], "left")
    status = (F.when(F.col("tag") == "", "empty")
              .when(~F.col("valid"), "invalid")
              .when(F.col("_over"), "too_many")
              .when(F.col("seq") > F.col("first_seq"), "duplicate")
              .otherwise("ok"))
    return out.select(*LIST_KEY, "seq", "raw", "tag", status.alias("status"))


def dedupe_tags(tags: DataFrame) -> DataFrame:
    """Valid entries, first occurrence per case-folded key, original case kept."""
    norm = normalize_tags(tags)
    first = _first_seen(norm)
    # one predicate over both sides, so it stays above the join (see _first_seen)
    return (norm.join(first, [*LIST_KEY, "key"], "inner")
            .filter(F.when(F.col("valid"), F.col("seq")) == F.col("first_seq"))
            .select(*LIST_KEY, "seq", "tag"))


def admitted(tags: DataFrame, cap: int = TAG_CAP) -> DataFrame:
    """The list as the reference would hold it: ``ok`` entries in order."""
    return admit_tags(tags, cap).filter(F.col("status") == "ok").select(*LIST_KEY, "seq", "tag")


def remove_tags(lists: DataFrame, removals: DataFrame | None = None,
                clears: DataFrame | None = None) -> DataFrame:
    """Drop named tags (exact, case-sensitive) and cleared lists.

    ``removals`` has ``(account, list_name, tag)``, ``clears`` has
    ``(account, list_name)``.  Both are de-duplicated first so the anti
    joins meet one build row per key.
    """
    out = lists
    if removals is not None:
        out = out.join(removals.select(*LIST_KEY, "tag").distinct(), [*LIST_KEY, "tag"], "left_anti")
    if clears is not None:
        out = out.join(clears.select(*LIST_KEY).distinct(), LIST_KEY, "left_anti")
    return out


def tag_list_size(lists: DataFrame, cap: int = TAG_CAP) -> DataFrame:
    """Entries per list and the ``n/cap`` label."""
    return (lists.groupBy(*LIST_KEY).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("label", F.concat(F.col("n").cast("string"), F.lit(f"/{cap}"))))

"""Audits of a recorded log (re-aims of the reference's pacing rules) and
reproducible draws: P12, P13, A12, W6, W7, O5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import seeded_bucket, seeded_hex
from ..plans.ranking import bucketed_row_number, chunked_lag, kth_per_group, struct_lt
from .quota import COMMENTS_CAP, LIKES_CAP

# fixed values: active hours, inclusive, local time
FIRST_HOUR = 8
LAST_HOUR = 23
SECONDS_PER_DAY = 86400


def local_hour(ts: str = "ts", tz: str = "UTC"):
    return F.hour(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz))


def active_hours(actions: DataFrame, first: int = FIRST_HOUR, last: int = LAST_HOUR,
                 tz: str = "UTC") -> DataFrame:
    """Rows whose local hour is in ``[first, last]``."""
    return actions.withColumn("local_hour", local_hour("ts", tz)) \
                  .filter(F.col("local_hour").between(first, last))


def hour_profile(actions: DataFrame, tz: str = "UTC") -> DataFrame:
    """Rows per local hour of day."""
    return actions.groupBy(local_hour("ts", tz).alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def min_gap_seconds(likes: int = LIKES_CAP, comments: int = COMMENTS_CAP) -> int:
    """Spacing rule: a day divided by (likes + comments + 1), truncated."""
    return int(SECONDS_PER_DAY / (likes + comments + 1))


def gap_audit(actions: DataFrame, likes: int = LIKES_CAP, comments: int = COMMENTS_CAP,
              by: Sequence[str] = ("account",), chunk: str = "hour") -> DataFrame:
    """Gap to the previous action of the same account, flagged when
    shorter than the spacing rule.

    The lag is computed per (account, ``chunk`` of ts) and patched across
    chunks from a one-row-per-chunk aggregate, so a hot account is split into
    hours (the window over chunks holds one small row per hour).
    """
    gap_us = min_gap_seconds(likes, comments) * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = actions.withColumn("_us", us)
    lagged = chunked_lag(d, list(by), F.date_trunc(chunk, F.col("ts")), ["ts", "id"], "_us", "_prev_us")
    return (lagged.withColumn("gap_us", F.col("_us") - F.col("_prev_us"))
            .withColumn("too_close", F.coalesce(F.col("gap_us") < F.lit(gap_us), F.lit(False)))
            .drop("_us", "_prev_us"))


def quota_audit(actions: DataFrame, cap: int, by: Sequence[str] = ("account", "date", "action_type"),
                order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Rows beyond the ``cap``-th of their (account, day, type) group."""
    by, order = list(by), list(order)
    if cap < 1:
        return actions
    kth = kth_per_group(actions, by, order, cap)
    here = [F.col(c) for c in order]
    over = struct_lt([F.col("kth_" + c) for c in order], here)
    return actions.join(kth, by, "inner").filter(over).drop(*["kth_" + c for c in order])


def hash_sample(df: DataFrame, key: str, pct: int, seed) -> DataFrame:
    """Reproducible ``pct`` percent sample keyed by md5(key|seed)."""
    return df.filter(seeded_bucket(key, seed, 100) < pct)


def seeded_order(df: DataFrame, key: str, seed, by: Sequence[str] = ("account",),
                 out: str = "rn") -> DataFrame:
    """Reproducible shuffle: rank per group by md5(key|seed), then key.

    md5 is uniform, so its first four hex digits split every group (hot ones
    too) into 65,536 ordered buckets; ranks are bucket prefix + local rank.
    """
    d = df.withColumn("_h", seeded_hex(key, seed))
    ranked = bucketed_row_number(d, list(by), F.substring("_h", 1, 4), [F.col("_h"), F.col(key)], out)
    return ranked.drop("_h")

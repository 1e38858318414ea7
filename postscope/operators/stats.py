"""Action-log statistics: P1-P3, A1-A9, A11, O1-O4.

All aggregates plan as partial + final hash aggregates, so a hot tag or type
is pre-combined map-side before the shuffle.  Pivots always take the fixed
type list (stable columns, no extra distinct job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import date_text

# fixed values: action types the views report, in display order
TYPES = ("like", "comment", "error")
SUCCESS_TYPES = ("like", "comment")
DEFAULT_DAYS = 7
TOP_TAGS = 10
LATEST_ERRORS = 10


def cutoff(as_of: str, days: int = DEFAULT_DAYS) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(int(days)))


def lookback(actions: DataFrame, as_of: str, days: int = DEFAULT_DAYS) -> DataFrame:
    """Rows since ``as_of - days`` (rolling, not calendar aligned).

    The typed ``ts`` predicate pushes into the parquet scan; on a stored log
    the ``date`` conjunct also prunes partitions.
    """
    c = cutoff(as_of, days)
    cond = F.col("ts") >= c
    if "date" in actions.columns:
        cond = cond & (F.col("date") >= F.to_date(c))
    return actions.filter(cond)


def tagged(actions: DataFrame) -> DataFrame:
    """Rows with a tag (empty text stays; only null is dropped)."""
    return actions.filter(F.col("hashtag").isNotNull())


def errors_only(actions: DataFrame) -> DataFrame:
    """Error rows, the three columns the error report prints."""
    return actions.filter(F.col("action_type") == "error").select("timestamp", "action_type", "error")


def _typed_counts(types=TYPES) -> list[Column]:
    return [F.count_if(F.col("action_type") == t).alias(t) for t in types]


def type_counts(actions: DataFrame, total: bool = False) -> DataFrame:
    """A1/A2: count per action type; ``total=True`` adds a null-type grand total."""
    if total:
        return actions.rollup("action_type").agg(F.count(F.lit(1)).alias("count"))
    return actions.groupBy("action_type").agg(F.count(F.lit(1)).alias("count"))


def headline(actions: DataFrame) -> DataFrame:
    """A3: one row of named counters, 0 when absent."""
    return actions.agg(F.count_if(F.col("action_type") == "like").alias("likes"),
                       F.count_if(F.col("action_type") == "comment").alias("comments"))


def action_history(actions: DataFrame, as_of: str, days: int = DEFAULT_DAYS) -> DataFrame:
    """A4 + O1: count per calendar date and type inside the lookback."""
    return (lookback(actions, as_of, days)
            .groupBy(date_text("timestamp").alias("date"), "action_type")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("date", "action_type"))


def history_pivot(actions: DataFrame, as_of: str, days: int = DEFAULT_DAYS,
                  types=TYPES, dense: bool = False) -> DataFrame:
    """A row per date with a 0-filled column per type (flagship view).

    Dates without actions are absent, as in the reference; ``dense=True``
    adds them with zeros (a generated date range left-joined to the counts).
    """
    counts = (lookback(actions, as_of, days)
              .groupBy(date_text("timestamp").alias("date"))
              .agg(*_typed_counts(types)))
    if dense:
        c = cutoff(as_of, days)
        spine = actions.sparkSession.range(1).select(
            F.explode(F.sequence(F.to_date(c), F.to_date(F.lit(as_of).cast("timestamp_ntz")))).alias("_d")
        ).select(F.date_format("_d", "yyyy-MM-dd").alias("date"))
        counts = spine.join(counts, "date", "left").fillna(0, subset=list(types))
    return counts.orderBy("date")


def tag_stats(actions: DataFrame) -> DataFrame:
    """A5 + O2: count per tag and type, largest first."""
    return (tagged(actions).groupBy("hashtag", "action_type")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "hashtag", "action_type"))


def tag_pivot(actions: DataFrame, types=TYPES) -> DataFrame:
    """A row per tag with a 0-filled column per type."""
    return tagged(actions).groupBy("hashtag").agg(*_typed_counts(types))


def top_tags(actions: DataFrame, n: int = TOP_TAGS) -> DataFrame:
    """A9 + O3: the ``n`` tags with most likes + comments (ties: tag asc).

    Plans as ``TakeOrderedAndProject``: each task keeps its local top n.
    """
    total = sum((F.col(t) for t in SUCCESS_TYPES), F.lit(0))
    return (tag_pivot(actions).withColumn("_total", total)
            .orderBy(F.desc("_total"), "hashtag").limit(n).drop("_total"))


def _rate(x: Column, total: Column) -> Column:
    return F.round(F.when(total > 0, (x * 100).cast("double") / total), 1)


def _success_cols() -> list[Column]:
    ok = F.count_if(F.col("action_type").isin(*SUCCESS_TYPES))
    err = F.count_if(F.col("action_type") == "error")
    return [ok.alias("success"), err.alias("errors")]


def _with_rates(df: DataFrame) -> DataFrame:
    total = F.col("success") + F.col("errors")
    return (df.withColumn("total", total)
            .withColumn("success_pct", _rate(F.col("success"), total))
            .withColumn("error_pct", _rate(F.col("errors"), total)))


def success_rate(actions: DataFrame) -> DataFrame:
    """Success (like + comment), errors, total, both percentages (null when total is 0)."""
    return _with_rates(actions.agg(*_success_cols()))


def tag_success(actions: DataFrame) -> DataFrame:
    """A6 per tag."""
    return _with_rates(tagged(actions).groupBy("hashtag").agg(*_success_cols()))


def latest_errors(actions: DataFrame, n: int = LATEST_ERRORS) -> DataFrame:
    """The ``n`` newest error rows (ties: higher id first)."""
    return (actions.filter(F.col("action_type") == "error")
            .orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
            .select("id", "timestamp", "action_type", "error"))

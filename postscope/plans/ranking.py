"""Skew-safe building blocks for per-group order statistics.

A plain ``Window.partitionBy(g)`` moves every row of a group into one task;
a hot account or tag holding a third of the log would then sit in a single
task.  These helpers keep every group split:

* ``kth_per_group`` / ``top_n_per_group`` filter ``row_number() <= k``; Catalyst
  inserts a *partial* ``WindowGroupLimit`` before the exchange, so each map
  task ships at most ``k`` rows per group (map-side top-k).
* ``bucketed_row_number`` ranks inside order buckets and adds a prefix of
  bucket counts, so the wide window runs per (group, bucket).
* ``chunked_lag`` computes ``lag`` per (group, chunk) and patches each chunk's
  first row with the previous chunk's last row from a small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import SPREAD_OPTION

# buckets of the first rank when k is above the map-side limit threshold
SALTS = 64


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int,
                    rank_col: str = "rn") -> DataFrame:
    """Rows ranked ``1..n`` per group by ``order`` (map-side limited).

    Catalyst adds the partial ``WindowGroupLimit`` only for ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``.  Beyond it a first
    rank runs inside ``SALTS`` buckets of each group (a deterministic hash of
    the order columns), keeping ``n`` rows per bucket: every row of the
    group's top ``n`` is in its bucket's top ``n``, so the group-wide rank
    then sees at most ``n * SALTS`` rows of a group, however large the group.
    Order columns with a unique tie-breaker (an id) are expected.
    """
    cols = _cols(order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salt = F.pmod(F.xxhash64(*cols), F.lit(SALTS))
        local = Window.partitionBy(*group, "_salt").orderBy(*cols)
        df = (df.withColumn("_salt", salt).withColumn("_local", F.row_number().over(local))
              .filter(F.col("_local") <= n).drop("_salt", "_local"))
    w = Window.partitionBy(*group).orderBy(*cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def kth_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int,
                  prefix: str = "kth_") -> DataFrame:
    """Per group, the ``order`` values of its ``k``-th smallest row.

    Groups with fewer than ``k`` rows are absent.  Output: group columns plus
    ``prefix + c`` for each order column.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    ranked = top_n_per_group(df.select(*group, *order), group, order, k, "_rn")
    return ranked.filter(F.col("_rn") == k).select(*group, *[F.col(c).alias(prefix + c) for c in order])


def struct_lt(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Lexicographic ``a < b`` over column tuples (no nulls expected)."""
    out = F.lit(False)
    eq = F.lit(True)
    for x, y in zip(a, b):
        out = out | (eq & (x < y))
        eq = eq & (x == y)
    return out


def bucketed_row_number(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence,
                        rank_col: str = "rn") -> DataFrame:
    """Exact ``row_number`` per group when ``bucket`` is monotone in ``order``.

    Rank = (rows of the group in earlier buckets) + (rank inside the bucket).
    The bucket counts are a partial aggregate; the prefix over buckets runs on
    one row per (group, bucket); the wide window runs per (group, bucket).
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    prefix = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")
                                     .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    local = Window.partitionBy(*group, "_bucket").orderBy(*_cols(order))
    return (b.withColumn("_local", F.row_number().over(local))
            .join(prefix, [*group, "_bucket"], "inner")
            .withColumn(rank_col, F.col("_before") + F.col("_local"))
            .drop("_bucket", "_before", "_local"))


def chunked_lag(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str],
                value: str, out: str) -> DataFrame:
    """Exact ``lag(value)`` over ``partitionBy(group).orderBy(order)``.

    ``chunk`` must be monotone in ``order`` (e.g. the day of ``ts``).  Inside a
    chunk the lag is a window per (group, chunk); the first row of a chunk
    takes the last ``value`` of the nearest earlier non-empty chunk, found from
    a one-row-per-chunk aggregate.
    """
    c = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*group, "_chunk").orderBy(*order)
    last = (c.groupBy(*group, "_chunk")
            .agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_last")))
    prev = last.withColumn(
        "_prev", F.lag(F.col("_last._v")).over(Window.partitionBy(*group).orderBy("_chunk"))
    ).select(*group, "_chunk", "_prev")
    return (c.withColumn("_lag_local", F.lag(value).over(local))
            .withColumn("_first", F.row_number().over(local) == 1)
            .join(prev, [*group, "_chunk"], "inner")
            .withColumn(out, F.when(F.col("_first"), F.col("_prev")).otherwise(F.col("_lag_local")))
            .drop("_chunk", "_lag_local", "_prev", "_first"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread CPU-heavy per-row text work over ``postscope.spread.partitions`` tasks.

    A plain, explicit ``repartition``: set the option when inputs arrive as a
    few large files (a single-row-group parquet file is one scan task, however
    large) or when the step follows a shuffle that AQE would coalesce into a
    few tasks by bytes (Python parsing has few bytes but much CPU per byte).
    Unset, as on a cluster whose scans are already wide, it is a no-op, so the
    text is not shuffled just to be parsed.  The partition key is a hash of
    ``keys``: a plain column key would be folded into an exchange of the same
    keys below it (e.g. a group-by of the pages), which AQE then coalesces.
    """
    n = int(df.sparkSession.conf.get(SPREAD_OPTION, "0") or 0)
    if n <= 0:
        return df
    return df.repartition(n, F.xxhash64(*keys)) if keys else df.repartition(n)

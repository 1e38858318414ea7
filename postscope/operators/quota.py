"""Quota with de-duplication, as set operations.

Sequential meaning (per run ``g``, rows in order ``o``): a row is *attempted*
when its post has no earlier success (in the history or earlier in the run)
and fewer than ``cap`` successes happened before it; it is *accepted* when it
was attempted and succeeded.  Failures use no quota and may be retried.

Set form used here (exact):

* the first success of each (run, post) is a partial aggregate ``min(o)``;
* ``n_before < cap``  <=>  ``o <= `` the ``cap``-th smallest first-success
  order of the run (a map-side limited rank, at most ``cap`` rows per group
  leave each map task);
* ``m_before``  <=>  ``o >`` the post's own first success.

Both small results join back on their keys, so no window ever holds a whole
run, and a hot account or post is combined map-side.

``quota_over_days`` adds the memory of the history test: a post accepted on one
day is done on the days after it.  Batch and the streaming form (T3) share it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import kth_per_group, struct_lt, top_n_per_group

# fixed values: default per-run caps
LIKES_CAP = 50
COMMENTS_CAP = 15


def apply_quota(cands: DataFrame, cap: int, by: Sequence[str], order: Sequence[str] = ("ts", "id"),
                post: str = "media_id", ok: str = "ok", history: str = "h") -> DataFrame:
    """Add ``attempted`` and ``accepted`` to ``cands``, each run ``by`` by itself.

    ``ok`` is the outcome of an attempt, ``history`` marks posts already done
    before the run.
    """
    by, order = list(by), list(order)
    h = F.coalesce(F.col(history), F.lit(False))
    firsts = _firsts(cands, by, order, post, ok, h)
    out = _join_ns(cands, firsts, [*by, post])
    here = [F.col(c) for c in order]
    first = [F.col("_first")[c] for c in order]
    m_before = F.col("_first").isNotNull() & struct_lt(first, here)
    if cap >= 1:
        flat = firsts.select(*by, *[F.col("_first")[c].alias(c) for c in order])
        out = _join_ns(out, kth_per_group(flat, by, order, cap), by)
        kth = [F.col("kth_" + c) for c in order]
        under = F.col("kth_" + order[0]).isNull() | ~struct_lt(kth, here)
    else:
        under = F.lit(False)
    attempted = ~h & under & ~m_before
    out = out.withColumn("attempted", attempted).withColumn("accepted", attempted & F.col(ok))
    return out.drop("_first", *[c for c in out.columns if c.startswith("kth_")])


def _firsts(cands: DataFrame, by: list[str], order: list[str], post: str, ok: str, h) -> DataFrame:
    """The first success of each post per run."""
    return cands.filter(~h & F.col(ok)).groupBy(*by, post).agg(F.min(F.struct(*order)).alias("_first"))


def quota_over_days(cands: DataFrame, cap: int, run: Sequence[str], day: str, order: Sequence[str] = ("ts", "id"),
                    post: str = "media_id", ok: str = "ok", history: str = "h", days: int | None = None) -> DataFrame:
    """The quota with memory: ``cap`` per ``run`` and ``day``, and a post that was accepted is done for ever.

    Sequential meaning: as ``apply_quota`` per (run, day), where a post accepted
    on an earlier day of the run is no longer attempted.  What a day accepts so
    depends on the days before it; the walk over the days only meets first
    successes per (run, day, post), and of those only the first ``cap * days``
    of each day: at most ``cap * (days - 1)`` posts can have been taken before,
    so the first ``cap`` free ones are among them.  That bound is kept map-side;
    a run, however hot, brings at most ``cap * days * days`` rows to its walk,
    which holds its accepted posts only.  ``days`` bounds the number of days of
    a run; it is counted when not given.
    """
    run, order = list(run), list(order)
    h = F.coalesce(F.col(history), F.lit(False))
    firsts = _firsts(cands, [*run, day], order, post, ok, h)
    flat = firsts.select(*run, day, post, *[F.col("_first")[c].alias(c) for c in order])
    if cap < 1:
        return cands.withColumn("attempted", F.lit(False)).withColumn("accepted", F.lit(False))
    if days is None:
        days = max(1, flat.agg(F.count_distinct(F.coalesce(F.col(day).cast("string"), F.lit("")))).first()[0])
    near = top_n_per_group(flat, [*run, day], order, cap * days, "_rn").drop("_rn")
    sorted_runs = near.repartition(*run).sortWithinPartitions(*run, day, *order)
    taken = sorted_runs.mapInArrow(_walk(cap, len(run)), near.schema)
    full = (taken.groupBy(*run, day).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*order)).alias("_last"))
            .filter(F.col("_n") == cap).drop("_n"))
    first = taken.select(*run, post, F.struct(day, *order).alias("_taken"))
    out = _join_ns(_join_ns(cands, full, [*run, day]), first, [*run, post])
    here = [F.col(c) for c in order]
    under = F.col("_last").isNull() | ~struct_lt([F.col("_last")[c] for c in order], here)
    free = F.col("_taken").isNull() | ~struct_lt([F.col("_taken")[c] for c in (day, *order)], [F.col(day), *here])
    attempted = ~h & under & free
    return out.withColumn("attempted", attempted).withColumn("accepted", attempted & F.col(ok)).drop("_last", "_taken")


def _walk(cap: int, runs: int):
    """Rows (run, day, post, ...) in order; keeps the first ``cap`` posts of each day that were not kept before."""
    def walk(batches):
        run = day = None
        taken, today = set(), 0
        for b in batches:
            keep = []
            for row in zip(*(b.column(i).to_pylist() for i in range(runs + 2))):
                if (row[:runs],) != run:
                    run, day, taken, today = (row[:runs],), None, set(), 0
                if (row[runs],) != day:
                    day, today = (row[runs],), 0
                new = today < cap and row[runs + 1] not in taken
                if new:
                    taken.add(row[runs + 1])
                    today += 1
                keep.append(new)
            yield b.filter(pa.array(keep, pa.bool_()))
    return walk


def _join_ns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe key equality (still a hash/merge equi-join).

    Null keys form one group, as in a window partition; and no ``isnotnull``
    filter is inferred into one branch only, so both uses of the
    first-success aggregate stay identical and share one exchange.
    """
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def with_history(cands: DataFrame, done: DataFrame, post: str = "media_id", out: str = "h",
                 by: Sequence[str] = ("account",), null_safe: bool = False) -> DataFrame:
    """Flag candidates whose post is in ``done`` of the same ``by`` (distinct ids, ids as text).

    ``null_safe``: a null key is a key of its own, as in a run's groups.
    """
    keys = [*by, post]
    ids = done.select(*[F.col(c).cast("string").alias(f"_h_{c}") for c in keys]).distinct().withColumn(out, F.lit(True))
    cond = F.lit(True)
    for c in keys:
        one = cands[c].cast("string")
        cond = cond & (one.eqNullSafe(ids[f"_h_{c}"]) if null_safe else one == ids[f"_h_{c}"])
    return (cands.join(ids, cond, "left").withColumn(out, F.coalesce(out, F.lit(False)))
            .drop(*[f"_h_{c}" for c in keys]))

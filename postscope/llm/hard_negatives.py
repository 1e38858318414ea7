"""Hard negatives by exact inner-product search with coordinate pruning (LEMP).

Vectors are integers: component x becomes floor(256 x).  For every anchor the
first ``positives`` rows of its label are found, then for every positive the
first ``negatives`` rows of other labels whose score lies between ``low`` and
``high`` per cent of the positive's.  First means by score, then by smaller id.

Rows are dealt by range of length (Euclidean norm), longest first, into blocks
of bounded size; anchors are cut into bounded groups, and a task meets one block
with one group of anchors.  Inside a block, length buckets hold, per coordinate,
the list of unit vectors sorted by that coordinate.  An anchor q that needs a
score of at least s from a bucket of greatest length m needs a cosine of
t = s / (|q| m) there: the bucket is left out when t > 1.  Else, for each of the
anchor's ``FOCUS`` largest coordinates a (of its unit vector), a row can reach t
only with a value within between the cosines of arccos(a) + arccos(t) and arccos(a) - arccos(t) there;
the sorted lists give these rows, their sets are intersected, and what is left
is verified exactly.  Where
the ranges take in most of a bucket, the bucket is verified as a whole, by one
matrix product.

The score needed starts from ``SEED`` rows picked by a hash of their ids, which
every anchor meets first: any k rows give a lower bound for the k-th best.  It
rises while a task goes through its buckets.  With it, blocks that are too short
for an anchor do not get the anchor at all.  The sample only sets bounds; all
rows are searched and the result is exact.

Products are sums of whole numbers: in doubles while they stay below 2^53, else
in Python's integers.  A score beyond 64 bits raises ``OverflowError``.

Defined cases: rows with a null id, label or vector, an empty vector, or a null
or non-finite component take no part; of rows that share an id, the one with the
least (label, vector) counts; vectors of unequal dimension do not meet; zero
vectors score 0; equal scores go to the smaller id; an anchor without positives,
or a window without rows, gives no row; empty tables give none; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, pick, staged

SCALE = 256.0
FOCUS = 6
# rows of the sample that sets the first bounds, of a length bucket, and the least and most of a block
SEED, BUCKET, BLOCK_MIN, BLOCK_MAX = 2_048, 1_024, 2_048, 32_768
ANCHORS = 65_536          # anchors of a group
TASKS = 20_000            # at most so many tasks for the tiles of a search
_CHUNK = 512              # anchors verified by one product
_EXACT = float(1 << 53)

_VECTOR = "vec_id long, label long, dim int, v binary, norm double"


def _pack(q: np.ndarray) -> bytes:
    small = np.abs(q).max() < (1 << 15)
    return q.astype("<i2" if small else "<f8").tobytes()


def _unpack(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<f8").astype(np.float64)


def _quantised(batches):
    for b in batches:
        out = []
        for i, label, vec in zip(*(b.column(k).to_pylist() for k in range(3))):
            if i is None or label is None or not vec or None in vec:
                continue
            x = np.asarray(vec, np.float64)
            if not np.isfinite(x).all():
                continue
            q = np.floor(SCALE * x)
            norm = float(np.linalg.norm(q / (top := max(np.abs(q).max(), 1.0)))) * top
            out.append((i, label, len(q), _pack(q), norm))
        cols = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64()))], ["vec_id", "label", "dim", "v", "norm"])


def prepared(rows: DataFrame, vec_id="vec_id", vector="embedding", label: Column | str = "label") -> DataFrame:
    """Whole-number vectors with their length; one row per id."""
    own = pick(rows, vec_id=vec_id, label=label, vector=vector)
    own = own.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    vectors = own.mapInArrow(_quantised, _VECTOR)
    return vectors.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v", "norm")).alias("r")).select("vec_id", "r.*")


class Wanted:
    """The search of one anchor group: per window the best rows so far and the score still needed."""

    def __init__(self, ids, labels, vectors, windows, k: int, same: bool):
        # windows: per anchor a list of (low, high, known lower bound)
        self.ids, self.labels, self.q, self.k, self.same = ids, labels, vectors, k, same
        self.norm = np.linalg.norm(vectors, axis=1)
        n = max((len(w) for w in windows), default=0)
        # extended precision holds every 64-bit number
        self.high = np.full((len(ids), n), -np.inf, np.longdouble)
        self.need = np.full((len(ids), n), np.inf, np.longdouble)      # no row is wanted where there is no window
        for i, ws in enumerate(windows):
            for j, (low, high, bound) in enumerate(ws):
                self.high[i, j] = np.inf if high is None else high
                self.need[i, j] = max((x for x in (low, bound) if x is not None), default=-np.inf)
        self.best: list[list[list[tuple[float, int]]]] = [[[] for _ in ws] for ws in windows]

    def offer(self, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        """Scores of rows ``ids`` (ascending) for anchors ``a``; keeps the best of each window."""
        fit = (labels[None, :] == self.labels[a, None]) == self.same
        if self.same:
            fit &= ids[None, :] != self.ids[a, None]
        for j in range(self.need.shape[1]):
            s = np.where(fit & (scores >= self.need[a, j, None]) & (scores <= self.high[a, j, None]), scores, -np.inf)
            if s.shape[1] > self.k:      # all rows at or above the k-th score
                kth = np.partition(s, -self.k, axis=1)[:, -self.k]
                s = np.where(s >= kth[:, None], s, -np.inf)
            x, y = np.nonzero(s > -np.inf)
            if not len(x):
                continue
            v = s[x, y]
            order = np.lexsort((ids[y], -v, x))
            x, y, v = x[order], y[order], v[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            few = place < self.k
            for i, row, score in zip(a[x[few]].tolist(), ids[y[few]].tolist(), v[few].tolist()):
                self.best[i][j].append((-score, row))
            for i in np.unique(a[x]).tolist():
                best = self.best[i][j] = sorted(self.best[i][j])[:self.k]
                if len(best) == self.k:
                    self.need[i, j] = max(self.need[i, j], -best[-1][0])


def _scores(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows of ``q`` and ``p``."""
    if np.abs(p).max(initial=0) * np.abs(q).max(initial=0) * p.shape[1] < _EXACT:
        return q @ p.T
    whole = [[int(x) for x in r] for r in p]
    out = np.empty((len(q), len(p)), object)
    for i, r in enumerate(q):
        r = [int(x) for x in r]
        out[i] = [sum(x * y for x, y in zip(r, w)) for w in whole]
        if any(abs(x) >= 1 << 63 for x in out[i]):
            raise OverflowError("a score beyond 64 bits")
    return out.astype(np.longdouble)


def _search(want: Wanted, ids: np.ndarray, labels: np.ndarray, p: np.ndarray) -> None:
    """Goes through the length buckets of one block, longest first."""
    norm = np.linalg.norm(p, axis=1)
    longest = np.argsort(-norm, kind="stable")
    unit_q = want.q / np.maximum(want.norm, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    value = np.take_along_axis(unit_q, focus, 1)
    for at in range(0, len(ids), BUCKET):
        rows = np.sort(longest[at:at + BUCKET])
        rows = rows[np.argsort(ids[rows], kind="stable")]
        bucket, m = p[rows], norm[rows].max()
        unit = bucket / np.maximum(norm[rows], 1e-300)[:, None]
        lists = np.argsort(unit, axis=0, kind="stable")
        sorted_values = np.take_along_axis(unit, lists, 0)
        need = want.need.min(axis=1, initial=np.inf).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = np.where(need > 0, need / (want.norm * m) - 1e-9, -1.0)
        a = np.flatnonzero(t <= 1)
        # the row lies within arccos t of the anchor, which lies arccos(value) from the axis
        wide, axis = np.arccos(np.maximum(t[a], -1.0))[:, None], np.arccos(np.clip(value[a], -1, 1))
        low, high = np.cos(np.minimum(axis + wide, np.pi)) - 1e-9, np.cos(np.maximum(axis - wide, 0)) + 1e-9
        first, last = np.zeros(low.shape, np.int64), np.zeros(low.shape, np.int64)
        for f in np.unique(focus[a]):
            x, y = np.nonzero(focus[a] == f)
            first[x, y] = np.searchsorted(sorted_values[:, f], low[x, y], "left")
            last[x, y] = np.searchsorted(sorted_values[:, f], high[x, y], "right")
        size = last - first
        least = size.min(axis=1, initial=len(rows))
        whole = a[least > len(rows) // 2]
        for c in range(0, len(whole), _CHUNK):
            part = whole[c:c + _CHUNK]
            want.offer(part, ids[rows], labels[rows], _scores(bucket, want.q[part]))
        for k in np.flatnonzero((least > 0) & (least <= len(rows) // 2)):
            keep = np.ones(len(rows), bool)
            for f, s, e in zip(focus[a[k]], first[k], last[k]):
                if e - s < len(rows):
                    inside = np.zeros(len(rows), bool)
                    inside[lists[s:e, f]] = True
                    keep &= inside
            found = np.flatnonzero(keep)
            if len(found):
                one = a[k:k + 1]
                want.offer(one, ids[rows[found]], labels[rows[found]], _scores(bucket[found], want.q[one]))


_TILE = "block int, grp int, kind int, vec_id long, label long, dim int, v binary, windows array<struct<low:long,high:long,bound:long>>"
_FOUND = "anchor_id long, place int, vec_id long, score long"


def _tiles(k: int, same: bool):
    def run(batches):
        for t in grouped(batches, 2):
            kind, ids, labels, dims = (t.column(c).to_numpy() for c in ("kind", "vec_id", "label", "dim"))
            v, windows = t.column("v"), t.column("windows")
            out: list[tuple[int, int, int, int]] = []
            for dim in np.unique(dims[kind == 1]).tolist():
                r, a = np.flatnonzero((kind == 0) & (dims == dim)), np.flatnonzero((kind == 1) & (dims == dim))
                if not len(r):
                    continue
                p, q = (np.stack([_unpack(v[int(i)].as_py(), dim) for i in which]) for which in (r, a))
                ws = [[(w["low"], w["high"], w["bound"]) for w in windows[int(i)].as_py()] for i in a]
                want = Wanted(ids[a], labels[a], q, ws, k, same)
                _search(want, ids[r], labels[r], p)
                out += [(int(i), j, row, int(-s)) for i, found in zip(ids[a], want.best)
                        for j, best in enumerate(found) for s, row in best]
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                             ["anchor_id", "place", "vec_id", "score"])
    return run


def _meet(blocks: DataFrame, anchors: DataFrame, tiles: tuple[int, int], k: int, same: bool) -> DataFrame:
    """The best ``k`` rows per (anchor, window place) over all blocks.

    ``anchors`` carries ``windows`` and ``last``: the last block it must meet (blocks are in order of length).
    """
    none = F.expr("cast(array() as array<struct<low:bigint,high:bigint,bound:bigint>>)")
    data = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(tiles[1] - 1))).alias("grp"), F.lit(0).alias("kind"),
                         "vec_id", "label", "dim", "v", none.alias("windows"))
    asked = anchors.filter("last >= 0").select(
        F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("block"), "grp", F.lit(1).alias("kind"), "vec_id", "label", "dim", "v", "windows")
    # a number of tasks of its own: the work goes with the products, not with the bytes
    tasks = min(tiles[0] * tiles[1], TASKS)
    dealt = data.unionByName(asked).repartition(tasks, "block", "grp").sortWithinPartitions("block", "grp", "kind", "vec_id")
    found = dealt.mapInArrow(_tiles(k, same), _FOUND)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def _bounds(best: DataFrame, k: int) -> DataFrame:
    """(anchor_id, place) -> the k-th best score, where there are k."""
    return best.filter(F.col("rn") == k).select("anchor_id", "place", F.col("score").alias("bound"))


def _last(lengths: list, blocks: int) -> Column:
    """The last block whose greatest length still reaches the score that an anchor needs (any of its windows)."""
    open_end = F.lit(-(1 << 63))
    least = F.array_min(F.transform("windows", lambda w: F.coalesce(F.greatest(w["low"], w["bound"]), open_end)))
    reach = F.col("norm") * (1 + 1e-9)
    ends = [F.when(reach * F.lit(top) >= least, F.lit(end)).otherwise(F.lit(-1)) for top, end in lengths]
    return (F.when(F.size("windows") == 0, F.lit(-1)).when(least <= 0, F.lit(blocks - 1))
            .otherwise(F.greatest(*ends, F.lit(-1))))


def _with_windows(anchors: DataFrame, windows: DataFrame, lengths: list, blocks: int) -> DataFrame:
    """windows: (anchor_id, place, low, high, bound)."""
    per = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high", "bound"))).alias("w"))
    ws = F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), w["bound"].alias("bound")))
    joined = anchors.join(per, anchors["vec_id"] == per["anchor_id"]).withColumn("windows", ws).drop("w", "anchor_id")
    return joined.withColumn("last", _last(lengths, blocks))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    vectors = staged(prepared(rows, vec_id, vector, label), "negatives-vectors")
    n, asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    size = min(max(math.ceil(n / 512), BLOCK_MIN), BLOCK_MAX)
    parts, groups = max(1, math.ceil(n / size)), max(1, math.ceil(asked / ANCHORS))
    dealt = vectors.repartitionByRange(parts, F.desc("norm"), "vec_id").withColumn("block", F.spark_partition_id())
    blocks = staged(dealt, "negatives-blocks")
    total = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    # at most 64 rows: greatest length and last block of each run of blocks
    run = F.floor(F.col("block") * 64 / total)
    lengths = [(r[1], r[2]) for r in blocks.groupBy(run.alias("run")).agg(F.max("norm"), F.max("block")).collect()] or [(0.0, -1)]
    anchors = blocks.filter(is_anchor).drop("block").withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    seed = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED).withColumn("block", F.lit(0))
    free = F.lit(None).cast("long")

    def search(windows: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        first = _meet(seed, _with_windows(anchors, windows.withColumn("bound", free), lengths, total)
                      .withColumn("last", F.when(F.col("last") >= 0, 0).otherwise(-1)), (1, groups), k, same)
        bound = windows.join(_bounds(first, k), ["anchor_id", "place"], "left")
        return staged(_meet(blocks, _with_windows(anchors, bound, lengths, total), (total, groups), k, same), name)

    all_rows = anchors.select(F.col("vec_id").alias("anchor_id"), F.lit(0).alias("place"), free.alias("low"), free.alias("high"))
    best = search(all_rows, positives, True, "negatives-positives")
    near = best.select("anchor_id", F.col("rn").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers: low * s <= 100 x <= high * s, in decimals since 100 s may pass 64 bits
    s = F.col("positive_score").cast("decimal(20,0)")
    window = near.select(
        "anchor_id", (F.col("place") - 1).alias("place"),
        F.ceil(s * low / F.lit(100)).cast("long").alias("low"), F.floor(s * high / F.lit(100)).cast("long").alias("high"),
    ).filter("low <= high")
    # places of an anchor without gaps, as the windows' array has them
    order = Window.partitionBy("anchor_id").orderBy("place")
    window = window.withColumn("asked", F.col("place")).withColumn("place", F.row_number().over(order) - 1)
    mined = search(window.drop("asked"), negatives, False, "negatives-mined")
    back = window.select("anchor_id", "place", (F.col("asked") + 1).alias("at"))
    return (mined.join(back, ["anchor_id", "place"])
            .join(near.select("anchor_id", F.col("place").alias("at"), "positive_id", "positive_score"), ["anchor_id", "at"])
            .select("anchor_id", "positive_id", F.col("rn").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))

"""Packing of token pieces into sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver.  The linear program over all patterns (multisets of lengths that fit a
sequence) is solved by multiplicative weights: every length has a price that
falls as it gets covered, knapsack dynamic programming finds the dearest
patterns at the current prices, and these get a small share of sequences.  The
shares are rounded down, and the few pieces left over are packed best fit.
Spark ranks the pieces inside their length and looks each rank up in the table
of patterns, whose size depends on the capacity and not on the data.

Defined cases: a null text is empty and holds the end id only; repeated rows are
separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import bucketed_row_number
from .common import pick, staged
from .token_ids import text_ids

CAPACITY = 1024
ROUNDS = 160        # price updates
SHARE = 1 / 80      # of a length's pieces that one pattern may take in a round
SHARPNESS = 30.0    # how fast the price of a covered length falls
NEAR = 0.97         # patterns worth this part of the dearest one are used too


def _piecer(path: str, end_id: int, capacity: int):
    def cut(batches):
        tok = text_ids(path)
        for b in batches:
            rid, doc, piece, start, length, crc = [], [], [], [], [], []
            for i in range(b.num_rows):
                ids = np.append(tok.ids(b.column(2)[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = list(range((n - 1) % capacity + 1, n + 1, capacity))
                for k, (s, e) in enumerate(zip([0, *cuts[:-1]], cuts)):
                    rid.append(b.column(0)[i].as_py())
                    doc.append(b.column(1)[i].as_py())
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(doc, b.schema.field(1).type), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["rid", "doc_id", "piece", "start", "length", "ids_crc32"])
    return cut


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece; a longer document is cut so that its first piece is the short one."""
    d = pick(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_piecer(tokenizer, end_id, capacity),
                        f"rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Pattern:
    lengths: list[int]     # in the order they lie in the sequence
    times: int


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dearest multiset of lengths for every capacity, and its last length (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], 0
        k = np.searchsorted(lengths, c, "right")
        if k:
            v = best[c - lengths[:k]] + price[:k]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], last[c] = v[j], lengths[j]
    return best, last


def _trace(last: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Pattern]:
    """Patterns that hold every piece of the histogram exactly once."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(x)] for x in lengths], float)
    place = {int(x): i for i, x in enumerate(lengths)}
    share: dict[tuple[int, ...], float] = {}
    cover = np.zeros(len(lengths))
    for _ in range(rounds):
        open_ = cover < 1
        if not open_.any():
            break
        price = np.where(open_, lengths / capacity * np.exp(-SHARPNESS * (cover - cover[open_].min())), 0.0)
        best, last = _knapsack(price, lengths, capacity)
        worth = price + best[capacity - lengths]
        for i in np.flatnonzero(open_ & (worth >= NEAR * worth[open_].max())):
            if cover[i] >= 1:
                continue
            p = tuple(sorted([int(lengths[i]), *_trace(last, capacity - int(lengths[i]))], reverse=True))
            at, a = np.unique([place[x] for x in p], return_counts=True)
            step = SHARE * (n[at] / a).min()
            share[p] = share.get(p, 0.0) + step
            cover[at] += a * step / n[at]
    left = n.astype(np.int64)
    out: list[Pattern] = []
    for p in sorted(share, key=lambda q: (-sum(q), -share[q])):
        at, a = np.unique([place[x] for x in p], return_counts=True)
        times = min(int(share[p]), int((left[at] // a).min()))
        if times > 0:
            left[at] -= a * times
            out.append(Pattern(list(p), times))
    return out + _best_fit({int(x): int(k) for x, k in zip(lengths, left) if k}, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing over a histogram; equal open sequences are handled together."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]   # by room left
    rooms = np.zeros(capacity + 1, np.int64)
    for x in sorted(counts, reverse=True):
        k = counts[x]
        while k:
            room = int(np.argmax(rooms[x:] > 0)) + x if rooms[x:].any() else 0
            if room:
                p, have = open_[room].popitem()
                use, fit = min(k, have), 1
                if use < have:
                    open_[room][p] = have - use
                rooms[room] -= use
            else:
                p, room = (), capacity
                fit = capacity // x
                use = k // fit
                if not use:
                    use, fit = 1, k
            q = p + (x,) * fit
            left = room - fit * x
            open_[left][q] = open_[left].get(q, 0) + use
            rooms[left] += use
            k -= use * fit
    return [Pattern(list(p), t) for by in open_ for p, t in by.items()]


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Sorted table: key (length, first rank) -> first rank, first sequence, offset."""
    rows, taken, seq = [], {}, 0
    for p in patterns:
        at = 0
        for x in p.lengths:
            rows.append((x, taken.get(x, 0), seq, at))
            taken[x] = taken.get(x, 0) + p.times
            at += x
        seq += p.times
    t = np.array(rows or np.empty((0, 4)), np.int64)
    return tuple(t[np.lexsort((t[:, 1], t[:, 0]))].T)


def _placer(shared):
    def place(batches):
        length, rank, seq, offset = shared.value
        key = (length << 44) | rank
        for b in batches:
            x, r = (b.column(n).to_numpy() for n in ("length", "rank"))
            i = np.searchsorted(key, (x << 44) | r, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.drop_columns(["rank"]).columns, pa.array(seq[i] + r - rank[i]), pa.array(offset[i])],
                names=[*b.drop_columns(["rank"]).schema.names, "sequence_id", "offset"])
    return place


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``, stored) plus ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_slots(solve(counts, capacity)))
    buckets = max(64, sum(counts.values()) // 1_000_000)
    ranked = bucketed_row_number(cut, ["length"], F.pmod(F.xxhash64("rid", "piece"), F.lit(buckets)),
                                 ["rid", "piece"], "rank").withColumn("rank", (F.col("rank") - 1).cast("long"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*cols, "rank").mapInArrow(
        _placer(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                         "sequence_id long, `offset` long")


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces of all documents with their sequence and offset."""
    return pack(staged(pieces(docs, tokenizer, end_id, capacity, doc_id, text), "pieces"), capacity)

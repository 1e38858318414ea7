"""Toxicity scores from a character n-gram linear classifier with naive Bayes scaling.

Features are hashed character n-grams (presence per document).  Document counts
per class over all labelled training rows give each n-gram's smoothed log-count
ratio; n-grams whose ratio is not significant are left out, and a logistic
regression is trained on presence times ratio.  Scores read whole texts.

The counts cover every labelled training row, and every significant bucket is a
feature.  Only the regression's weights are fitted on a sample, of about
``fit_rows`` rows chosen by a hash of the id, which reach the driver as lists of
kept n-grams.  The rarer class has a quarter of the sample at least (all its rows
if there are fewer); rows count by the inverse of their class's share.  Should the
sample still hold one class only, the log-count ratios are the weights.

Defined cases: null or empty texts have no n-gram and score as the intercept; a
document labelled twice counts as toxic if one label says so; null labels are
not used; without labels of both classes every score is the share of toxic
training rows (0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pick, slices, utf8

GRAMS = (3, 4, 5)
BUCKET_BITS = 18
FIT_ROWS = 8_000               # rows of the regression at most (the driver holds their kept n-grams)
BROADCAST_LABELS = 2_000_000   # labels (about 16 bytes each) sent to every executor at most
MIN_Z = 3.5                    # least significance of a log-count ratio
THRESHOLD = 0.3


@dataclass
class Model:
    weight: np.ndarray      # per bucket: regression weight times log-count ratio, 0 if left out
    bias: float


_STEP = np.uint32(0x9E3779B1)     # odd multiplier, a fixed value


def _bucket(h: np.ndarray) -> np.ndarray:
    """Well mixed high bits of 32-bit hashes."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BUCKET_BITS)


def _grams(text_data: np.ndarray, off: np.ndarray, used: np.ndarray | None):
    """(document, bucket) pairs, each once; ``used`` restricts the buckets."""
    text = text_data.tobytes()
    docs = [text[a:b].decode("utf-8", "replace").lower() for a, b in zip(off[:-1], off[1:])]
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(size)
    chars = np.frombuffer("".join(docs).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    # a slice holds few documents, so that most pairs fit 32 bits, which sort faster
    kind = np.uint32 if len(docs) <= 1 << (32 - BUCKET_BITS) else np.uint64
    doc = np.repeat(np.arange(len(docs), dtype=kind) << kind(BUCKET_BITS), size)
    room = np.repeat(ends, size) - np.arange(len(chars))      # characters to the end of the document
    out = []
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, GRAMS[-1] + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = h[:m] * _STEP + chars[n - 1:]                     # the n-gram's hash from the one before
        if n not in GRAMS:
            continue
        b = _bucket(h)
        ok = room[:m] >= n
        if used is not None:
            ok &= used[b]
        at = np.flatnonzero(ok)
        out.append(doc[at] | b[at])
    keys = np.sort(np.concatenate(out)) if out else np.empty(0, kind)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return (keys >> kind(BUCKET_BITS)).astype(np.int64), (keys & kind((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _count(batches):
    """Per bucket the documents of each class (this task's share)."""
    n = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for b in batches:
        data, off = utf8(b.column(0))
        y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows += np.bincount(y, minlength=2)[:2]
        for i, j in slices(off):
            d, f = _grams(data[off[i]:off[j]], off[i:j + 1] - off[i], None)
            for c in (0, 1):
                n[c] += np.bincount(f[y[i + d] == c], minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(n.sum(0))
    at = np.concatenate([at, [-1]])  # bucket -1: the documents themselves
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(np.append(n[0][at[:-1]], rows[0])),
         pa.array(np.append(n[1][at[:-1]], rows[1]))], names=["bucket", "ok", "toxic"])


def _lister(shared):
    def kept(batches):
        used = shared.value
        for b in batches:
            data, off = utf8(b.column(0))
            found: list[np.ndarray] = []
            for i, j in slices(off):
                d, f = _grams(data[off[i]:off[j]], off[i:j + 1] - off[i], used)
                found += np.split(f.astype(np.int32), np.searchsorted(d, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "buckets"])
    return kept


def _regress(flat: np.ndarray, size: np.ndarray, y: np.ndarray, ratio: np.ndarray, part: np.ndarray, steps: int = 300, l2: float = 1e-4):
    """Logistic regression on presence * ratio; Adam on the full sample, deterministic.

    ``flat``: the kept n-grams of all rows, ``size`` of them per row; ``part``: the rows' weights, 1 in all.
    """
    used = np.flatnonzero(ratio)
    place = np.zeros(len(ratio), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    cols = place[flat]
    n = len(size)
    # the same matrix by rows and by columns: products are sums of runs
    full = np.flatnonzero(size)
    starts = np.cumsum(np.append(0, size))[:-1][full]
    turn = np.argsort(cols, kind="stable")
    at_c = np.repeat(np.arange(n, dtype=np.int32), size)[turn]
    have, starts_c = np.unique(cols, return_counts=True)
    starts_c = np.cumsum(np.append(0, starts_c))[:-1]
    del turn
    scale = ratio[used]
    rate = float(part @ y)
    w, bias = np.zeros(len(used)), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(n, bias)
        if len(cols):
            z[full] += np.add.reduceat((w * scale).astype(np.float32)[cols], starts)
        e = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * part
        g, gb = l2 * w, e.sum()
        if len(cols):
            g[have] += np.add.reduceat(e.astype(np.float32)[at_c], starts_c) * scale[have]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a = 0.05 * np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
        w -= a * m / (np.sqrt(v) + 1e-8)
        bias -= a * mb / (np.sqrt(vb) + 1e-8)
    out = np.zeros(len(ratio))
    out[used] = w * ratio[used]
    return out, bias


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
        label_id: str = "doc_id", toxic: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Train on the rows of ``docs`` that ``train`` selects and that have a label."""
    spark = docs.sparkSession
    y = (pick(labels, id=label_id, y=labels[toxic].cast("int")).filter("id is not null and y in (0, 1)")
         .groupBy("id").agg(F.max("y").alias("y")))
    if labels.count() <= BROADCAST_LABELS:
        y = F.broadcast(y)
    d = pick(docs, id=doc_id, text=text, train=train).filter("train").join(y, "id").select("id", "text", "y")
    got = (d.select("text", "y").mapInArrow(_count, "bucket int, ok long, toxic long")
           .groupBy("bucket").agg(F.sum("ok").alias("ok"), F.sum("toxic").alias("toxic")).toPandas())
    n = np.zeros((2, 1 << BUCKET_BITS))
    is_row = got["bucket"].to_numpy() < 0
    n_ok, n_toxic = (float(got.loc[is_row, c].sum()) for c in ("ok", "toxic"))
    g = got[~is_row]
    n[0][g["bucket"].to_numpy()], n[1][g["bucket"].to_numpy()] = g["ok"].to_numpy(), g["toxic"].to_numpy()
    if not n_ok or not n_toxic:
        rate = n_toxic / max(1.0, n_ok + n_toxic)
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    p, q = (n[1] + 0.5) / (n_toxic + 1), (n[0] + 0.5) / (n_ok + 1)
    ratio = np.log(p / q)
    z = ratio / np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
    z[(np.abs(z) < MIN_Z) | (n.sum(0) < 3)] = 0.0
    ratio[z == 0] = 0.0
    rare = min(n_ok, n_toxic)
    rare_rows = max(fit_rows * rare / (n_ok + n_toxic), min(rare, fit_rows / 4))
    share = [min(1.0, (rare_rows if c == rare else fit_rows - rare_rows) / c) for c in (n_ok, n_toxic)]
    most = [int(s * (1 << 40)) for s in share]
    chosen = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) < F.when(F.col("y") == 1, most[1]).otherwise(most[0])
    shared = spark.sparkContext.broadcast(ratio != 0)
    rows = d.filter(chosen).select("text", "y").mapInArrow(_lister(shared), "y int, buckets array<int>").toArrow().combine_chunks()
    y01 = rows.column("y").to_numpy().astype(float)
    sampled = np.bincount(y01.astype(int), minlength=2)
    if not sampled.all():
        return Model(ratio, float(np.log(n_toxic / n_ok)))
    part = (np.array([n_ok, n_toxic]) / (n_ok + n_toxic) / sampled)[y01.astype(int)]
    lists = rows.column("buckets").combine_chunks()
    weight, bias = _regress(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), y01, ratio, part)
    return Model(weight, bias)


def _scorer(shared):
    def score(batches):
        m: Model = shared.value
        used = m.weight != 0
        for b in batches:
            data, off = utf8(b.column("text"))
            z = np.full(len(off) - 1, m.bias)
            for i, j in slices(off):
                d, f = _grams(data[off[i]:off[j]], off[i:j + 1] - off[i], used)
                z[i:j] += np.bincount(d, m.weight[f], j - i)
            rest = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))],
                                             names=[*rest.schema.names, "score"])
    return score


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The ``keep`` columns plus ``score`` (0 to 1) and ``predicted``."""
    d = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).alias("text"))
    schema = StructType([f for f in d.schema.fields if f.name != "text"])
    for name, kind in (("score", "double"),):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (d.mapInArrow(_scorer(shared), schema)
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))

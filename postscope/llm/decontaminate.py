"""Benchmark decontamination by winnowing.

Winnowing keeps the minimum k-gram hash of every sliding window.  With k = 7
words and 7 grams per window, every 13-word span keeps at least one fingerprint
and equal spans keep the same one, so a shared span of 13 words or more is never
missed.  Documents keep only fingerprints that occur in the benchmark (a
fixed-size Bloom filter of the benchmark's fingerprints); each hit is extended
to the 13-word windows around it, and windows are joined to the benchmark's
windows by their words, so hash collisions never count.  An item of fewer than
13 words is one window; its length n is fingerprinted with k = n and one gram
per window.

Defined cases: null or empty texts have no words; an item without words has no
window; repeated rows are separate documents; a null item id reads as an empty
text; an empty table on either side gives no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, pick, slices, staged, utf8

SPAN = 13
GRAM = 7
FILTER_BITS = 26


def _selected(w: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes and a mask of the positions winnowing keeps."""
    g, _ = w.grams(gram)
    per = span - gram + 1
    n = len(g) - per + 1
    keep = np.zeros(len(g), bool)
    if n <= 0:
        return g, keep
    inside = w.last_start(n, span)
    low = g[:n].copy()
    for j in range(1, per):
        np.minimum(low, g[j:j + n], out=low)
    for j in range(per):
        keep[j:j + n] |= inside & (g[j:j + n] == low)
    return g, keep


def _shape(span: int) -> int:
    return GRAM if span == SPAN else span


def _item_rows(batches):
    """Per item: its windows' words, and the fingerprints of each window length."""
    for b in batches:
        data, off = utf8(b.column(1))
        ids, spans, words, prints = [], [], [], []
        for i, j in slices(off):
            w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i])
            for d in range(j - i):
                f, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
                if not n:
                    continue
                one = Words(data[off[i + d]:off[i + d + 1]], np.array([0, off[i + d + 1] - off[i + d]]))
                span = min(n, SPAN)
                g, keep = _selected(one, span, _shape(span))
                ids.append(b.column(0)[i + d].as_py())
                spans.append(span)
                words.append([w.text(f + p, span) for p in range(n - span + 1)])
                prints.append(np.unique(g[keep]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(spans, pa.int32()),
             pa.array(words, pa.list_(pa.binary())), pa.array(prints, pa.list_(pa.int64()))],
            names=["item", "span", "words", "prints"])


def bench_windows(items: DataFrame) -> DataFrame:
    """(item, span, words, prints) per item with words; ``items`` has (item, text)."""
    return items.select("item", "text").mapInArrow(
        _item_rows, "item string, span int, words array<binary>, prints array<long>")


def _bitmap(windows: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Per window length a bit table of the fingerprints; its size is fixed by ``bits``.

    A larger benchmark fills the table and lets more candidates through; the
    join by words keeps the result the same.
    """
    fp = (windows.select("span", F.explode("prints").alias("p"))
          .select("span", F.shiftrightunsigned("p", 64 - bits).alias("slot"))
          .groupBy("span", F.shiftright("slot", 6).alias("word"))
          .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))
    out: dict[int, np.ndarray] = {}
    for r in fp.toLocalIterator():  # at most SPAN * 2**(bits - 6) words
        t = out.setdefault(r["span"], np.zeros(1 << (bits - 6), np.uint64))
        t[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


def _scanner(shared, bits: int):
    def scan(batches):
        tables = shared.value
        cut, six, low6 = np.uint64(64 - bits), np.uint64(6), np.uint64(63)
        for b in batches:
            data, off = utf8(b.column(3))
            n_words = np.zeros(len(off) - 1, np.int64)
            found: list[list] = [[] for _ in range(len(off) - 1)]
            for i, j in slices(off):
                w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n_words[i:j] = np.diff(w.first)
                for span, bitmap in tables.items():
                    g, keep = _selected(w, span, _shape(span))
                    at = np.flatnonzero(keep)
                    slot = g[at] >> cut
                    at = at[(bitmap[slot >> six] >> (slot & low6)) & np.uint64(1) == 1]
                    if not len(at):
                        continue
                    # extend a fingerprint to every window of the text that holds it
                    reach = span - _shape(span)
                    starts = np.unique(at[:, None] - np.arange(reach + 1)[None, :])
                    starts = starts[(starts >= 0) & (starts + span <= len(w.start))]
                    starts = starts[w.last_start(len(w.start), span)[starts]]
                    doc = np.searchsorted(w.first, starts, "right") - 1
                    for s, d in zip(starts.tolist(), doc.tolist()):
                        found[i + d].append({"start": s - int(w.first[d]), "len": span, "words": w.text(s, span)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n_words),
                 pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("words", pa.binary())])))],
                names=["rid", "doc_id", "t64", "n_words", "windows"])
    return scan


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: (rid, doc_id, t64, n_words, n_hit, items).

    ``items``: sorted ids (as text) of the benchmark items with an occurring
    window.  ``n_hit``: words inside any occurrence.  ``t64``: hash of the text,
    to find the row again.
    """
    spark = docs.sparkSession
    bench = staged(bench_windows(pick(items, item=F.coalesce(items[item_id].cast("string"), F.lit("")), text=item_text)),
                   "bench-windows")
    shared = spark.sparkContext.broadcast(_bitmap(bench, filter_bits))
    d = pick(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = staged(
        d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("t64"), "text").mapInArrow(
            _scanner(shared, filter_bits),
            f"rid long, doc_id {kind}, t64 long, n_words long, windows array<struct<start:int,len:int,words:binary>>"),
        "winnowed")
    of = bench.select("item", F.explode(F.array_distinct("words")).alias("words")).distinct()
    cand = rows.filter(F.size("windows") > 0).select("rid", F.explode("windows").alias("w")).select("rid", "w.*")
    hit = staged(cand.join(of.select("words").distinct(), "words", "inner"), "window-hits")
    # a text's own windows, in order: count words under their union
    merged = F.expr(
        "aggregate(array_sort(collect_list(struct(start, len))), struct(0 as upto, 0 as n), "
        "(a, w) -> struct(greatest(a.upto, w.start + w.len) as upto, "
        "a.n + greatest(0, w.start + w.len - greatest(a.upto, w.start)) as n), a -> a.n)")
    words = hit.groupBy("rid").agg(merged.cast("long").alias("n_hit"))
    named = (hit.select("rid", "words").distinct().join(of, "words").select("rid", "item").distinct()
             .groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    return (rows.select("rid", "doc_id", "t64", "n_words").join(words.join(named, "rid"), "rid", "left")
            .select("rid", "doc_id", "t64", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))

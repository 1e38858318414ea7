"""Removal of passages that repeat anywhere in the corpus, by sampled suffixes.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere
else.  Like a difference-cover suffix sort, the search names a sample of all
suffixes by their prefixes, drops suffixes whose name is unique, recurses on the
others with finer names, and settles the unsampled positions through the sample
that serves them:

1. Every window of ``span`` bytes has one sample, the least 16-byte gram among
   the first ``REACH``; equal windows have it at the same distance, so one
   suffix in about ``REACH / 2`` is enough (residues of a fixed cover would need
   far more, as they cannot follow the text).
2. A sample's windows form a cell.  Its core name hashes the bytes all windows
   of such a cell hold: if it is unique, none of them repeats, and the cell is
   dropped.  Only then the others get a full name, which hashes all the bytes
   they hold: if two cells share it, all of them repeat.
3. Cells with a shared core but a unique full name (the edges of a repeated
   passage) are cut into smaller cells and named again, together with one
   witness of every settled cell of the same core, down to single windows.

Names are grouped with partial aggregates, so a passage in very many documents
is counted map-side; no pairs of copies are formed.  Full names have 128 bits.

Defined cases: a null text is empty; texts shorter than ``span`` keep all their
bytes; repeated rows are separate documents, so each makes the other's text go;
matches never cross documents; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decided, pick, slices, staged, utf8
from .suffix_kernels import cells, cores, covered, samples

SPAN = 400
REACH = 256
STEPS = (16, 1)        # cell sizes of the finer levels

_CELL = pa.struct([(n, pa.int64()) for n in ("a", "lo", "hi", "core")])
_CELL_SQL = "array<struct<a:long,lo:long,hi:long,core:long>>"


def _lists(counts: np.ndarray, columns: list[np.ndarray]) -> pa.Array:
    """Cells grouped by row as a list column."""
    off = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], fields=list(_CELL)))


def _first_names(span: int, reach: int):
    def name(batches):
        for b in batches:
            data, off = utf8(b.column(2))
            digest = [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(off[:-1], off[1:])]
            counts, parts = [], []
            for i, j in slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                a, lo, hi = samples(d, o, span, reach)
                doc = np.searchsorted(o, lo, "right") - 1
                core = cores(d, a, span, reach) if len(a) else a.astype(np.uint64)
                parts.append([a - o[doc], lo - o[doc], hi - o[doc], core])
                counts.append(np.bincount(doc, minlength=j - i))
            if not parts:
                continue
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(off)), pa.array(digest, pa.string()),
                 _lists(np.concatenate(counts), [np.concatenate(x) for x in zip(*parts)])],
                names=["doc_id", "t64", "n_bytes", "sha256", "cells"])
    return name


def _finer_names(span: int, step: int):
    def name(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for k in range(b.num_rows):
                todo = b.column(2)[k].values
                a, lo, hi = (todo.field(i).to_numpy() for i in range(3))
                edge = todo.field(3).to_numpy(zero_copy_only=False)
                row, first, last, core, full = cells(data[off[k]:off[k + 1]], a, lo, hi, span, step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[k].as_py()] * len(row), pa.int64()), pa.array(a[row]), pa.array(first), pa.array(last),
                     pa.array(core.view(np.int64)), pa.array(full[:, 0].copy().view(np.int64)),
                     pa.array(full[:, 1].copy().view(np.int64)), pa.array(edge[row])],
                    names=["rid", "a", "lo", "hi", "core", "f1", "f2", "edge"])
    return name


def _shared(named: DataFrame) -> DataFrame:
    """Cells whose core name is not unique."""
    # stored, so that both sides of the join arrive by a plain exchange that can be split where a core is hot
    names = staged(named.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "shared-cores")
    return staged(named.join(names, "core", "left_semi"), "shared-cells")


def _settle(named: DataFrame, first: bool, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(repeated cells, cells to name again) of one level; on the first all cores are shared."""
    full = ["core", "f1", "f2"]
    if last:
        again = staged(named.groupBy(*full).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-names")
        return named.filter("edge").join(again, full, "left_semi").select("rid", "lo", "hi"), None
    kept = named if first else _shared(named)
    classes = kept.groupBy(*full).agg(F.count("*").alias("n"), F.min(F.struct("rid", "a", "lo", "hi")).alias("one"),
                                      F.max("edge").alias("some_edge"))
    twice = staged(classes, "cell-classes")
    repeated = kept.filter("edge").join(twice.filter("n > 1").select(*full), full, "left_semi").select("rid", "lo", "hi")
    alone = twice.filter("n = 1 and some_edge")
    open_cores = alone.select("core").distinct()
    witness = twice.filter("n > 1 or not some_edge").join(open_cores, "core", "left_semi")
    todo = (alone.select("one.*", F.lit(True).alias("edge"))
            .unionByName(witness.select("one.*", F.lit(False).alias("edge"))))
    return repeated, todo


def _cutter(span: int):
    def cut(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            removed, spans, digest, kept = [], [], [], []
            for k in range(b.num_rows):
                body = data[off[k]:off[k + 1]]
                v = b.column(2)[k].values
                s, e = covered(v.field(0).to_numpy(), v.field(1).to_numpy() + span)
                parts = [body[x:y].tobytes() for x, y in zip(np.append(0, e), np.append(s, len(body)))]
                rest = b"".join(parts)
                removed.append(len(body) - len(rest))
                spans.append(len(s))
                digest.append(hashlib.sha256(rest).hexdigest())
                # text form: a character cut in two goes with its passage
                kept.append(b"".join(p.decode("utf-8", "ignore").encode() for p in parts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["rid", "n_removed", "n_spans", "kept_sha256", "kept_text"])
    return cut


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                      reach: int = REACH, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(rid, doc_id, t64, n_bytes, n_removed, n_spans, kept_sha256, kept_text) per document.

    ``kept_text`` is null where nothing goes; ``t64`` (hash of the text) finds
    the row again.
    """
    d = pick(docs, doc_id=doc_id, text=docs[text].cast("string"))
    kind = d.schema["doc_id"].dataType.simpleString()
    keyed = d.select("doc_id", F.xxhash64("text").alias("t64"), "text")
    spark = docs.sparkSession
    cell = F.struct("a", "lo", "hi", "edge")

    # what a level leaves is one table; those it needed on the way are removed
    def sampled() -> DataFrame:
        rows = staged(keyed.mapInArrow(_first_names(span, reach), f"doc_id {kind}, t64 long, n_bytes long, sha256 string, cells {_CELL_SQL}")
                      .withColumn("rid", F.monotonically_increasing_id()), "suffix-samples")
        shared = _shared(rows.select("rid", F.explode("cells").alias("c")).select("rid", "c.*")).withColumn("edge", F.lit(True))
        return rows.drop("cells").join(shared.groupBy("rid").agg(F.collect_list(cell).alias("todo")), "rid", "left")

    rows = decided(spark, sampled, "sampled-documents")
    lists = rows.filter("todo is not null")
    # texts of the documents that hold a shared cell, once
    texts = staged(keyed.withColumnRenamed("doc_id", "d").withColumnRenamed("t64", "t").join(
        lists, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("t64"))).select("rid", "text"), "touched-texts")
    hits = []
    steps = (reach, *steps)
    for k, step in enumerate(steps):
        def level(k=k, step=step, lists=lists) -> DataFrame:
            named = staged(texts.join(lists.select("rid", "todo"), "rid").select("rid", "text", "todo").mapInArrow(
                _finer_names(span, step), "rid long, a long, lo long, hi long, core long, f1 long, f2 long, edge boolean"), "finer-cells")
            found, todo = _settle(named, k == 0, k == len(steps) - 1)
            found = found.select("rid", F.lit(0).cast("long").alias("a"), "lo", "hi", F.lit(True).alias("edge"), F.lit(False).alias("again"))
            return found if todo is None else found.unionByName(todo.withColumn("again", F.lit(True)))

        left = decided(spark, level, "settled-cells")
        hits.append(left.filter("not again").select("rid", "lo", "hi"))
        lists = left.filter("again").groupBy("rid").agg(F.collect_list(cell).alias("todo"))
    cover = hits[0]
    for h in hits[1:]:
        cover = cover.unionByName(h)
    per_doc = cover.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("cover"))
    cut = (texts.join(per_doc, "rid").select("rid", "text", "cover")
           .mapInArrow(_cutter(span), "rid long, n_removed long, n_spans long, kept_sha256 string, kept_text string"))
    none = F.lit(0).cast("long")
    # the texts of repeated rows were joined to each of them
    return rows.drop("todo").join(cut.dropDuplicates(["rid"]), "rid", "left").select(
        "rid", "doc_id", "t64", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept_text")

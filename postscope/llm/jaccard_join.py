"""Near-duplicate documents by a chosen-path join over word n-gram sets.

Documents with equal n-gram sets are one class.  Every class has ``COORDS``
min-hash coordinates, the tokens that a random order of all n-grams puts first.
A run starts with all classes in one node and splits each node on ``FAN``
sampled coordinates: classes that share the sampled token go to the same child.
Nodes are split until they are small or hold near copies, which no split takes
apart, and then compared by brute force, a large one in tiles of ``TILE`` x
``TILE`` classes.  The sizes of a node's children tell which: the sum of their
squares over ``FAN`` times the node's own is the share of its pairs that agree on
a sampled coordinate.  It is low where the classes have only a passage in common.  Runs are repeated until a
pair at the threshold is met with probability ``RECALL``.

A pair that meets in several nodes is judged in the smallest of them only, so
links are counted once without writing pairs: tiles give counts per class and
the edges of a spanning forest.  Min-hashes only propose; a pair links when the
Jaccard similarity of the two whole n-gram sets reaches the threshold.

Defined cases: a text of fewer than n words is one n-gram of all its words; a
null text, or one without words, links with nothing and is a class of its own;
repeated rows are separate documents that link; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Words, grouped, mix, pick, slices, staged, utf8
from .graph import components

NGRAM = 5
THRESHOLD = 0.8
COORDS = 64
FAN = 2
DEPTH = 6
LEAF = 48              # a node of at most so many classes is compared at once
TILE = 128
RECALL = 0.9999
PROPOSE = 0.5          # least share of equal coordinates: six deviations below the threshold


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, fan: int = FAN, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold shares a final node with the wanted probability.

    All runs draw from the same coordinates, so the miss is averaged over how many of them agree.
    """
    miss, weight = [], []
    for a in range(COORDS + 1):
        q = 1.0
        for _ in range(depth):
            q = 1 - (1 - a / COORDS * q) ** fan
        miss.append(1 - q if a >= PROPOSE * COORDS else 1.0)
        weight.append(math.comb(COORDS, a) * threshold ** a * (1 - threshold) ** (COORDS - a))
    runs = 1
    # agreement below PROPOSE is lost in any number of runs
    while runs < COORDS and sum(w * m ** runs for w, m in zip(weight, miss)) > 1 - recall:
        runs += 1
    return runs


def ngram_sets(w: Words, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    count = np.diff(w.first)
    g = {k: w.grams(k)[0] for k in ({n} | set(int(c) for c in np.unique(count) if 0 < c < n))}
    out = []
    for f, c in zip(w.first[:-1], count):
        if c >= n:
            out.append(np.unique(g[n][f:f + c - n + 1]))
        else:
            out.append(g[int(c)][f:f + 1] + np.uint64(c) if c else np.empty(0, np.uint64))
    return out


def _coordinates(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash coordinates (rows x COORDS, 32 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDS), np.uint32)
    for t in range(COORDS):
        turn = np.uint64(mix(np.array([t + 1], np.uint64))[0])
        h = (flat ^ turn) * (turn | np.uint64(1)) + np.uint64(BASE)
        out[:, t] = (np.minimum.reduceat(h, at) >> np.uint64(16)).astype(np.uint32)
    return out


def _sketch(n: int):
    def sketch(batches):
        for b in batches:
            data, off = utf8(b.column(2))
            rows = len(off) - 1
            size = np.zeros(rows, np.int32)
            key = np.zeros((rows, 2), np.int64)
            sig: list[bytes | None] = [None] * rows
            for i, j in slices(off):
                sets = ngram_sets(Words(data[off[i]:off[j]], off[i:j + 1] - off[i]), n)
                full = [k for k in range(j - i) if len(sets[k])]
                if not full:
                    continue
                coords = _coordinates([sets[k] for k in full])
                for k, c in zip(full, coords):
                    s = sets[k]
                    size[i + k] = len(s)
                    key[i + k] = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64)]).view(np.int64)
                    sig[i + k] = c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sig, pa.binary())],
                names=["doc_id", "t64", "size", "k1", "k2", "sig"])
    return sketch


def _split(batches):
    """Children of each (node, class): one per sampled coordinate of the node."""
    for b in batches:
        node = b.column(0).to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, COORDS)
        row = np.arange(b.num_rows)
        kids, at, taken = [], [], []
        for f in range(FAN):
            c = (mix(node + np.uint64(f + 1)) % np.uint64(COORDS)).astype(np.int64)
            for before in taken:   # distinct coordinates
                c = np.where(c == before, (c + 1) % COORDS, c)
            taken.append(c)
            kids.append(mix(node * np.uint64(BASE) + (c.astype(np.uint64) << np.uint64(32)) + sig[row, c]))
            at.append(row)
        order = pa.array(np.concatenate(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(kids).view(np.int64)), b.column(1).take(order), b.column(0).take(order), b.column(3).take(order)],
            names=["node", "cid", "parent", "above"])


def _propose(batches):
    """Per class of a tile: a bit map of the partners to compare exactly."""
    for t in grouped(batches, 3):
        rows = t.num_rows
        if rows < 2:
            continue
        leaf, ti, tj = (t.column(i)[0].as_py() for i in range(3))
        cid = t.column("cid").to_numpy()
        side = t.column("block").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(rows, COORDS)
        lists = t.column("leaves").to_pylist()
        width = max(map(len, lists))
        leaves = np.array([x + x[-1:] * (width - len(x)) for x in lists], np.int64)
        pairs = np.zeros((rows, rows), bool)
        for i in range(rows - 1):
            other = (sig[i + 1:] == sig[i]).mean(1) >= PROPOSE
            if ti != tj:
                other &= side[i + 1:] != side[i]
            at = np.flatnonzero(other) + i + 1
            if len(at):  # judged elsewhere if the two share a smaller node
                earlier = np.zeros(len(at), bool)
                for v in lists[i]:
                    if v < leaf:
                        earlier |= (leaves[at] == v).any(1)
                pairs[i, at[~earlier]] = True
        pairs |= pairs.T
        some = np.flatnonzero(pairs.any(1))
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([leaf] * n, pa.int64()), pa.array([ti] * n, pa.int32()), pa.array([tj] * n, pa.int32()),
                 pa.array(cid[some]), pa.array(some.astype(np.int32)),
                 pa.array([np.packbits(pairs[k]).tobytes() for k in some])],
                names=["leaf", "ti", "tj", "cid", "place", "partners"])


def _judge(n: int, threshold: float):
    def judge(batches):
        for t in grouped(batches, 3):
            place, first = np.unique(t.column("place").to_numpy(), return_index=True)   # repeated rows of one text
            t = t.take(pa.array(first))
            rows = len(place)
            sets = []
            for text in t.column("text").to_pylist():
                raw = np.frombuffer((text or "").encode(), np.uint8)
                sets += ngram_sets(Words(raw, np.array([0, len(raw)])), n)
            size = np.array([len(s) for s in sets])
            number, flat = np.unique(np.concatenate(sets), return_inverse=True)
            flat = flat.astype(np.int32)
            start = np.cumsum(np.append(0, size[:-1]))
            cid, weight = t.column("cid").to_numpy(), t.column("n_docs").to_numpy()
            links = np.zeros(rows, np.int64)
            root = np.arange(rows)
            mark = np.zeros(len(number), bool)
            bits = t.column("partners").to_pylist()
            for i in range(rows):
                mine = np.unpackbits(np.frombuffer(bits[i], np.uint8))[place] > 0
                at = np.flatnonzero(mine[i + 1:]) + i + 1
                # sizes alone rule out a pair whose smaller set is below the threshold's share
                at = at[np.minimum(size[at], size[i]) >= threshold * np.maximum(size[at], size[i])]
                if not len(at):
                    continue
                mark[flat[start[i]:start[i] + size[i]]] = True
                both = np.add.reduceat(mark[flat].astype(np.int32), start)[at] if len(at) > 8 else \
                    np.array([mark[flat[start[k]:start[k] + size[k]]].sum() for k in at])
                mark[flat[start[i]:start[i] + size[i]]] = False
                at = at[both >= threshold * (size[at] + size[i] - both) - 1e-9]
                links[i] += weight[at].sum()
                links[at] += weight[i]
                for k in at.tolist():
                    a, b = i, k
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    root[max(a, b)] = min(a, b)
            got = np.flatnonzero(links)
            up = root.copy()
            while (up[up] != up).any():
                up = up[up]
            yield pa.RecordBatch.from_arrays([pa.array(cid[got]), pa.array(links[got]), pa.array(cid[up[got]])],
                                             names=["cid", "links", "tie"])
    return judge


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM,
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, t64, class_id, n_links, kept).

    ``class_id``: smallest doc_id reachable by links; ``n_links``: documents
    linked directly; ``kept``: one document of each class; ``t64``: hash of the
    text, to find the row again.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    keyed = d.select("doc_id", F.xxhash64("text").alias("t64"), "text")
    rows = staged(keyed.mapInArrow(_sketch(n), f"doc_id {kind}, t64 long, size int, k1 long, k2 long, sig binary")
                  .withColumn("rid", F.monotonically_increasing_id()), "sketches")
    same = ["k1", "k2", "size"]
    classes = staged(rows.filter("size > 0").groupBy(*same).agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "t64")).alias("rep"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = _links(classes, keyed, n, threshold)
    ties = components(found.select(F.col("cid").alias("a"), F.col("tie").alias("b")))
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = (classes.select("cid", "n_docs", *same).join(sums, "cid", "left")
              .join(ties.withColumnRenamed("node", "cid"), "cid", "left")
              .select(*same, (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("label", "cid").alias("label")))
    joined = staged(rows.drop("sig").join(labels, same, "left")
                    .withColumn("label", F.coalesce("label", -1 - F.col("rid"))), "labelled")
    # one row per label with several rows; stored, so that a large class is split in the join
    best = staged(joined.groupBy("label").agg(F.min(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("n"))
                  .filter("n > 1").select("label", "best"), "best-rows")
    alone = F.col("best").isNull()
    return joined.join(best, "label", "left").select(
        "doc_id", "t64", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("rid") == F.col("best.rid"))).alias("kept"))


def _links(classes: DataFrame, keyed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cid, links, tie): direct links per class and tile, and the class it is tied to."""
    seeds = F.explode(F.array(*[F.lit(int(x)) for x in mix(np.arange(1, runs_for(threshold=threshold) + 1, dtype=np.uint64)).view(np.int64)]))
    few = classes.count()
    todo = classes.select(seeds.alias("node"), "cid", "sig", F.lit(few).cast("long").alias("above"))
    # so few classes are compared at once, without a split
    leaves = classes.select(F.lit(0).cast("long").alias("leaf"), "cid", F.lit(few).cast("long").alias("n")) if few <= LEAF else None
    for depth in range(DEPTH if few > LEAF else 0):
        kids = staged(todo.mapInArrow(_split, "node long, cid long, parent long, above long"), "nodes")
        # stored, so that both sides of the joins arrive by a plain exchange that can be split where a node is hot
        size = staged(kids.groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("above").alias("above"))
                      .filter("n > 1"), "node-sizes")
        # nodes of near copies: splitting on does not help, they are compared as they are
        agree = F.sum(F.col("n").cast("double") * F.col("n")) / (FAN * F.first("above").cast("double") * F.first("above"))
        near = staged(size.groupBy("parent").agg(agree.alias("agree")).filter(F.col("agree") >= PROPOSE).select("parent"), "near-nodes")
        done = (todo.select("node", "cid", "above").join(near, F.col("node") == F.col("parent"), "left_semi")
                .select(F.col("node").alias("leaf"), "cid", F.col("above").alias("n")))
        leaves = done if leaves is None else leaves.unionByName(done)
        sized = kids.select("node", "cid").join(size.join(near, "parent", "left_anti").select("node", "n"), "node")
        final = F.lit(True) if depth == DEPTH - 1 else F.col("n") <= LEAF
        leaves = leaves.unionByName(sized.filter(final).select(F.col("node").alias("leaf"), "cid", "n"))
        if depth == DEPTH - 1:
            break
        todo = staged(sized.filter(~final).select("node", "cid", F.col("n").alias("above"))
                      .join(classes.select("cid", "sig"), "cid").select("node", "cid", "sig", "above"), "large-nodes")
        if todo.limit(1).count() == 0:
            break
    leaves = staged(leaves, "leaves")
    mine = leaves.groupBy("cid").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int")
    tiles = (leaves.join(mine.join(classes.select("cid", "sig"), "cid"), "cid")
             .withColumn("blocks", F.when(F.col("n") <= TILE, 1).otherwise(blocks))
             .withColumn("block", F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("leaf", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
                     "block", "cid", "leaves", "sig"))
    tile = ["leaf", "ti", "tj"]
    proposed = staged(tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(
        _propose, "leaf long, ti int, tj int, cid long, place int, partners binary"), "proposed")
    of = classes.select("cid", "n_docs", F.col("rep.doc_id").alias("rep_id"), F.col("rep.t64").alias("t64"))
    wanted = proposed.join(of, "cid")
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["rep_id"]) & (keyed["t64"] == wanted["t64"])).select(
        *tile, "place", "cid", "n_docs", "partners", "text")
    return staged(texts.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(
        _judge(n, threshold), "cid long, links long, tie long"), "judged")

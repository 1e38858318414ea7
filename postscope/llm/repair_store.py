"""Token-id files compressed by Re-Pair grammars.

Documents are sorted by id over range partitions; each task cuts its run of
token ids into shards of about ``SHARD_TOKENS`` ids (whole documents).  Inside a
shard, frequent pairs of neighbouring ids are replaced by new symbols again and
again; the rules, the number of ids each symbol expands to, and the place of
every document are stored with the remaining symbols, so one document is decoded
without the rest of its shard.

File format: a Parquet data set with one row per shard:
``part, block, before`` (range partition, shard in it, ids in it before the
shard), ``doc_ids``, ``ends`` (ids of the shard up to and including each
document) and ``body``.  ``body`` is little-endian: the magic ``RPG1``, four
unsigned 32-bit counts (rules, symbols, documents, first new symbol), then
unsigned 32-bit arrays: left and right side of each rule, its expansion length,
the end of each document in symbols, the symbols; last, the crc32 of all that.

Defined cases: a null text is empty and holds the end id only; repeated rows and
repeated ids are separate documents, in the order of a hash of their text; an
empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, pick, slices, utf8
from .token_ids import text_ids

MAGIC = b"RPG1"
SHARD_TOKENS = 1 << 19
TEXT_BYTES = 1 << 22    # of texts encoded together
SLOTS = 19              # bits of the pair table
ROUNDS = 8              # passes over a shard at most
RULES_PER_ROUND = 1 << 13
MIN_COUNT = 8           # a pair is frequent if it occurs that often in its shard
MIN_GAIN = 0.01         # stop when a pass shortens the shard by less


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS, min_count: int = MIN_COUNT) -> bytes:
    """Grammar of a shard; ``ends`` are the documents' ends in ids.

    Pairs are counted in a hash table of ``SLOTS`` bits; a slot's pair is the
    first one found there, and others wait for a later pass.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    first_new = int(seq.max()) + 1 if len(seq) else 0
    left, right = np.empty(0, np.uint32), np.empty(0, np.uint32)
    length = np.ones(first_new, np.uint32)
    for turn in range(rounds):
        at = np.flatnonzero(~last)                # a pair never spans two documents
        if not len(at):
            break
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        slot = (((key ^ np.uint64(turn)) * np.uint64(BASE)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        count = np.bincount(slot, minlength=1 << SLOTS)
        often = np.flatnonzero(count >= min_count)
        if len(often) > RULES_PER_ROUND:
            often = often[np.argpartition(-count[often], RULES_PER_ROUND)[:RULES_PER_ROUND]]
        rule_of = np.full(1 << SLOTS, -1, np.int32)
        rule_of[often] = np.arange(len(often))
        rule = rule_of[slot]
        hit = np.flatnonzero(rule >= 0)
        rule, key, pos = rule[hit], key[hit], at[hit]
        pair = np.empty(len(often), np.uint64)
        pair[rule[::-1]] = key[::-1]
        same = pair[rule] == key
        rule, pos = rule[same], pos[same]
        if not len(pos):
            break
        # of overlapping pairs take every second, from the left
        run = np.ones(len(pos), bool)
        run[1:] = np.diff(pos) > 1
        place = np.arange(len(pos))
        every = (place - place[run][np.cumsum(run) - 1]) % 2 == 0
        rule, pos = rule[every], pos[every]
        used = np.bincount(rule, minlength=len(often)) >= max(2, min_count // 2)
        keep = used[rule]
        rule, pos = rule[keep], pos[keep]
        if len(pos) < MIN_GAIN * len(seq):
            break
        new = first_new + len(left)
        left = np.append(left, (pair[used] >> np.uint64(32)).astype(np.uint32))
        right = np.append(right, (pair[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        length = np.append(length, length[left[new - first_new:]] + length[right[new - first_new:]])
        seq[pos] = (new + np.cumsum(used) - 1).astype(np.uint32)[rule]
        last[pos] = last[pos + 1]
        stay = np.ones(len(seq), bool)
        stay[pos + 1] = False
        seq, last = seq[stay], last[stay]
    parts = [left, right, length[first_new:], np.flatnonzero(last) + 1, seq]
    body = MAGIC + struct.pack("<4I", len(left), len(seq), len(ends), first_new) + b"".join(
        np.asarray(p, "<u4").tobytes() for p in parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """Reader of one shard's ``body``."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC or struct.unpack("<I", body[-4:])[0] != zlib.crc32(body[:-4]):
            raise ValueError("not a whole shard")
        rules, symbols, docs, self.first_new = struct.unpack("<4I", body[4:20])
        self.rules = rules
        flat = np.frombuffer(body, "<u4", 3 * rules + docs + symbols, 20)
        cut = np.cumsum([rules, rules, rules, docs])
        self.left, self.right, self.length, self.doc_ends, self.symbols = np.split(flat, cut)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols (one pass per level of the grammar)."""
        seq = symbols
        while True:
            new = seq >= self.first_new
            if not self.rules or not new.any():
                return seq
            place = np.cumsum(1 + new) - 1 - new
            out = np.empty(int(place[-1] + 1 + new[-1]), np.uint32)
            rule = seq[new] - self.first_new
            out[place[~new]] = seq[~new]
            out[place[new]] = self.left[rule]
            out[place[new] + 1] = self.right[rule]
            seq = out

    def document(self, k: int) -> np.ndarray:
        """Ids of document ``k`` alone."""
        start = int(self.doc_ends[k - 1]) if k else 0
        return self.expand(self.symbols[start:int(self.doc_ends[k])])

    def size(self, symbols: np.ndarray) -> int:
        """Ids that symbols expand to, from the stored lengths."""
        new = symbols >= self.first_new
        return int((~new).sum()) + int(self.length[symbols[new] - self.first_new].sum()) if self.rules else len(symbols)

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)


def _encoder(path: str, end_id: int, shard_tokens: int, id_type: pa.DataType):
    def encode(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        tok = text_ids(path)
        end = np.array([end_id], np.uint32)
        state = {"block": 0, "before": 0}
        ids: list[np.ndarray] = []
        names: list = []
        ends: list[int] = []

        def flush():
            body = compress(np.concatenate(ids), np.array(ends, np.int64))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([state["block"]], pa.int32()), pa.array([state["before"]], pa.int64()),
                 pa.array([names[:]], pa.list_(id_type)), pa.array([ends[:]], pa.list_(pa.int64())), pa.array([body])],
                names=["part", "block", "before", "doc_ids", "ends", "body"])
            state["block"] += 1
            state["before"] += ends[-1]
            ids.clear(), names.clear(), ends.clear()
            return row

        for b in batches:
            for i, j in slices(utf8(b.column(1))[1], TEXT_BYTES):
                texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                for name, got in zip(b.column(0).slice(i, j - i).to_pylist(), tok.many(texts)):
                    ids += [got, end]
                    names.append(name)
                    ends.append((ends[-1] if ends else 0) + len(got) + 1)
                    if ends[-1] >= shard_tokens:
                        yield flush()
        if ends:
            yield flush()
    return encode


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text and write the shards below ``path`` in ascending id order."""
    d = pick(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    (d.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "text")
     .mapInArrow(_encoder(tokenizer, end_id, shard_tokens, to_arrow_type(kind)),
                 f"part int, block int, before long, doc_ids array<{kind.simpleString()}>, ends array<long>, body binary")
     .write.parquet(path))


def _decode(batches):
    for b in batches:
        for k in range(b.num_rows):
            shard = Shard(b.column(4)[k].as_py())
            ends = np.asarray(b.column(3)[k].values.to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            raw = shard.ids().astype("<u4")
            crc = [zlib.crc32(raw[s:e]) for s, e in zip(starts, ends)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, b.column(0)[k].as_py(), np.int32)), b.column(2)[k].values,
                 pa.array(b.column(1)[k].as_py() + starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode every shard: (doc_id, start, n_tokens, ids_crc32) per document."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    rows = shards.select("part", "before", "doc_ids", "ends", "body").mapInArrow(
        _decode, f"part int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    # one row per range partition: a small window
    size = shards.groupBy("part").agg(F.max(F.col("before") + F.element_at("ends", -1)).alias("n"))
    base = size.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

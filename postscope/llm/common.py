"""Helpers shared by the operators: scratch tables, byte and word kernels.

The kernels run inside Spark tasks on Arrow batches.  They work on the
concatenated UTF-8 bytes of a bounded slice of rows (``slices``), so the memory
of a task depends on the slice limit and its longest single text only.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

SLICE_BYTES = 1 << 19
# odd multiplier of the polynomial hashes (2^64 / golden ratio), a fixed value
BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64 finaliser, fixed values

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage at a file every executor can read, so a lost executor
    costs no recomputation of what came before.  ``by``: columns that get a
    folder each.
    """
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a scratch table, removed with those of the ``decided`` call it belongs to."""
    path = scratch_path(spark, name)
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


# scratch tables written inside a ``decided`` call; each call has its own list
_owned: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def decided(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of ``make``; the scratch tables written while making it are removed.

    Only its own tables: other results, of this thread or another, keep theirs.
    Inside another such call the result is one of that call's scratch tables.
    """
    path = scratch(spark, name)
    return spark.read.schema(settle(spark, make, path)).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> StructType:
    """``decided`` with a folder for the result: its schema."""
    paths: list[str] = []
    outer = _owned.set(paths)
    try:
        found = make()
        found.write.parquet(path)
    finally:
        _owned.reset(outer)
    remove(spark, paths)
    return found.schema


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)


def pick(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named inputs, under private names: other columns cannot clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def crc_text(c: Column) -> Column:
    """Unsigned crc32 of the UTF-8 text of a column (long)."""
    return F.crc32(c.cast("string").cast("binary"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column (null reads as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes (a single longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2^64 for ``i < n`` (kept between calls)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            k = 1
            while k < size:
                p[k:2 * k] = p[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """``c`` with ``(c[e] - c[s]) * base**-s`` = polynomial hash of ``data[s:e]``."""
    pw, _ = powers(len(data) + 1, base)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = BASE) -> np.ndarray:
    _, inv = powers(len(c), base)
    return (c[e] - c[s]) * inv[s]


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64) so that every bit of the hash is usable."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
# word bytes of lower-cased text: 0-9, a-z and every non-ASCII byte
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


class Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased (A-Z) texts.

    ``data``/``off`` as from ``utf8``.  ``start``/``end`` are byte positions,
    ``hash`` a 64-bit hash per word, ``first[d]:first[d + 1]`` the words of text
    ``d``.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = low = LOWER[data]
        w = IS_WORD[low]
        edge = np.zeros(len(w) + 1, bool)
        edge[off] = True
        before = np.zeros(len(w), bool)
        before[1:] = w[:-1]
        after = np.zeros(len(w), bool)
        after[:-1] = w[1:]
        self.start = np.flatnonzero(w & (~before | edge[:-1]))
        self.end = np.flatnonzero(w & (~after | edge[1:])) + 1
        self.hash = mix(span_hash(prefix_hash(low), self.start, self.end))
        self.first = np.searchsorted(self.start, off)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words, and whether it stays in its text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        g = np.zeros(n, np.uint64)
        for j in range(k):
            g = g * np.uint64(BASE) + self.hash[j:j + n]
        return mix(g), self.last_start(n, k)

    def last_start(self, n: int, k: int) -> np.ndarray:
        """For word positions ``0..n-1``: do ``k`` words from there stay in the text?"""
        ok = np.zeros(n, bool)
        room = np.diff(self.first) - k + 1
        for f, r in zip(self.first[:-1][room > 0], room[room > 0]):
            ok[f:f + r] = True
        return ok

    def text(self, i: int, n: int) -> bytes:
        """Words ``i..i+n-1`` joined by one space."""
        low = self.low
        return b" ".join(low[s:e].tobytes() for s, e in zip(self.start[i:i + n], self.end[i:i + n]))


def grouped(batches, keys: int):
    """Runs of equal first ``keys`` columns as tables (the input is sorted by them)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:]):
            part = b.slice(s, e - s)
            if held and any(held[0].column(i)[0].as_py() != part.column(i)[0].as_py() for i in range(keys)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

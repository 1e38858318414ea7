"""Exact "text contains pattern" joins (J4 titles, J5 term tables), one method at every size.

A pattern is contained in a text only if the pattern's key gram is: its whole
text when it has fewer than ``Q`` bytes, else the one of its ``Q``-byte grams
that is rarest in a sample of the texts, so that a pattern is proposed where its
least common part occurs, not wherever a common word does.  One pass over the
texts packs the grams of every needed length (at most ``Q`` lengths) into
integers and keeps those whose bit is set in a table of the patterns' key grams;
an equi-join on (length, gram) proposes patterns per text, and every proposal is
verified with ``contains`` on the whole text.  The table has ``SPARSE`` bits per
pattern, so the share of grams that pass by chance stays the same as patterns
grow, up to 2^``MAX_BITS`` bits (8 MB) per length; a fuller table only proposes
more.  The sample (at most ``SAMPLE`` texts) and the table change the work, never
the result.  A text meets its proposals as one array, once, and keys are
compared null-safely.

Callers pass already case-folded text and pattern columns.  Empty or null
patterns and null texts never match.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 8                      # bytes of a key gram: one 64-bit integer
MIN_BITS, MAX_BITS = 16, 26     # of the table of key grams, per gram length
SPARSE = 64                # bits per pattern
SAMPLE = 128               # texts that tell rare grams from common ones
COUNT_BITS = 20            # slots of the sample's gram counts
SLICE_BYTES = 1 << 17      # text handled at once inside a task (its grams fit a cache)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slices(col: pa.Array):
    """(first row, bytes, offsets) of bounded runs of a text column."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    body = col.buffers()[2] if len(col) else None
    data = np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, len(col))
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def _grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every ``n``-byte gram as an integer, and its row (grams never span rows)."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g |= data[k:k + m].astype(np.uint64) << np.uint64(8 * k)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    ok = np.arange(m) + n <= off[row + 1]
    return g[ok], row[ok]


def _slot(g: np.ndarray, bits: int) -> np.ndarray:
    return (g * _MIX) >> np.uint64(64 - bits)


def _sample_counts(batches):
    """Slots of the ``Q``-byte grams of texts, each text's grams once."""
    for b in batches:
        for _, data, off in _slices(b.column(0)):
            g, row = _grams(data, off, Q)
            once = np.sort(row.astype(np.uint64) << np.uint64(COUNT_BITS) | _slot(g, COUNT_BITS))
            once = once[np.flatnonzero(np.diff(once, prepend=~once[:1]))] & np.uint64((1 << COUNT_BITS) - 1)
            counts = np.bincount(once.astype(np.int64), minlength=1 << COUNT_BITS)
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["s", "n"])


def _common(texts: DataFrame, pats: DataFrame) -> np.ndarray:
    """How many patterns, and texts of a sample, hold each gram slot; the driver gets at most 2^``COUNT_BITS`` numbers.

    What many patterns share is common too: it tells the grams apart that the sample does not hold.
    """
    some = texts.select("_text").limit(SAMPLE).unionByName(pats.select(F.col("_pat").alias("_text")))
    found = some.mapInArrow(_sample_counts, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[found.column("s").to_numpy()] = found.column("n").to_numpy()
    return counts


def _key_gram(pattern: str, common: np.ndarray) -> tuple[int, int]:
    """Length and value of a pattern's key gram (of a long one: the rarest, then the one with the smallest mix)."""
    raw = pattern.encode()
    n = min(Q, len(raw))
    g, _ = _grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), n)
    if n == Q:
        seen = common[_slot(g, COUNT_BITS).astype(np.int64)]
        g = g[seen == seen.min()]
    return n, int(g[np.argmin(g * _MIX)].view(np.int64))


def _keyer(bits: int, shared):
    """Add each pattern's key gram and its slot in the table."""
    def key(batches):
        for b in batches:
            keys = [_key_gram(x, shared.value) for x in b.column(b.num_columns - 1).to_pylist()]
            n, g = (np.array(x, np.int64) for x in (zip(*keys) if keys else ((), ())))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n.astype(np.int32)), pa.array(g), pa.array(_slot(g.view(np.uint64), bits).astype(np.int64))],
                names=[*b.schema.names, "n", "g", "s"])
    return key


def _table(keys: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Bit table of the key grams per length; at most ``Q * 2**(bits - 6)`` words."""
    words = (keys.groupBy("n", F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")))
    got = words.toArrow()
    n, w, b = (got.column(c).to_numpy() for c in ("n", "w", "bits"))
    out: dict[int, np.ndarray] = {}
    for length in np.unique(n).tolist():
        t = out[length] = np.zeros(1 << (bits - 6), np.uint64)
        t[w[n == length]] = b[n == length].view(np.uint64)
    return out


def _hits(data: np.ndarray, off: np.ndarray, tables: dict[int, np.ndarray], table_bits: int):
    """Per length the grams whose bit is set, and their rows; a gram is the one a byte shorter and its next byte."""
    if not len(data):
        return
    g = np.zeros(len(data), np.uint64)
    for n in range(1, max(tables, default=0) + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        g = g[:m]
        g |= data[n - 1:].astype(np.uint64) << np.uint64(8 * (n - 1))
        if n not in tables:
            continue
        s = _slot(g, table_bits)
        at = np.flatnonzero((tables[n][s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1))
        row = np.searchsorted(off, at, "right") - 1
        inside = at + n <= off[row + 1]
        yield n, g[at[inside]], row[inside]


def _finder(shared, table_bits: int):
    def find(batches):
        tables = shared.value
        for b in batches:
            lens: list = [[] for _ in range(b.num_rows)]
            vals: list = [[] for _ in range(b.num_rows)]
            for first, data, off in _slices(b.column(b.num_columns - 1)):
                for n, g, row in _hits(data, off, tables, table_bits):
                    # one entry per row and gram
                    order = np.lexsort((g, row))
                    g, row = g[order], row[order]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                    g, row = g[new].view(np.int64), row[new]
                    for r, part in zip(range(len(off) - 1), np.split(g, np.searchsorted(row, np.arange(1, len(off) - 1)))):
                        if len(part):
                            lens[first + r] += [n] * len(part)
                            vals[first + r] += part.tolist()
            keep = [i for i, v in enumerate(vals) if v]
            ends = pa.array(np.cumsum([0] + [len(vals[i]) for i in keep]).astype(np.int32))
            flat = pa.StructArray.from_arrays(
                [pa.array([n for i in keep for n in lens[i]], pa.int32()), pa.array([g for i in keep for g in vals[i]], pa.int64())],
                fields=[pa.field("n", pa.int32()), pa.field("g", pa.int64())])
            grams, keep = pa.ListArray.from_arrays(ends, flat), pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(keep) for c in b.columns[:-1]], grams],
                                             names=[*b.schema.names[:-1], "_grams"])
    return find


_PAIRS = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("g", T.LongType())]))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(right[f"_k{i}"])
    return cond


def proposals(texts: DataFrame, text_keys: Sequence[str], text: str,
              pats: DataFrame, pat_keys: Sequence[str], pat: str, table_bits: int | None = None) -> DataFrame:
    """Per text (keys ``_k0``...) the patterns whose key gram it holds, as ``_prop``: to be verified."""
    sc = texts.sparkSession.sparkContext
    p = pats.select(*pat_keys, F.col(pat).alias("_pat")).filter(F.length("_pat") > 0)
    t = texts.select(*text_keys, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    if table_bits is None:
        table_bits = min(MAX_BITS, max(MIN_BITS, (SPARSE * p.count()).bit_length()))
    p = p.mapInArrow(_keyer(table_bits, sc.broadcast(_common(t, p))), T.StructType([*p.schema.fields, T.StructField("n", T.IntegerType()),
                                           T.StructField("g", T.LongType()), T.StructField("s", T.LongType())]))
    shared = sc.broadcast(_table(p, table_bits))
    schema = T.StructType([t.schema[k] for k in text_keys] + [T.StructField("_grams", _PAIRS)])
    grams = t.mapInArrow(_finder(shared, table_bits), schema).select(*text_keys, F.explode("_grams").alias("_g")).select(*text_keys, "_g.n", "_g.g")
    named = F.struct(*[F.col(k) for k in pat_keys], F.col("_pat"))
    return (grams.join(p, ["n", "g"]).groupBy(*text_keys).agg(F.collect_set(named).alias("_prop"))
                .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(text_keys)], "_prop"))


def matches(texts: DataFrame, text_keys: Sequence[str], text: str,
            pats: DataFrame, pat_keys: Sequence[str], pat: str, table_bits: int | None = None) -> DataFrame:
    """Rows of ``texts`` that contain a pattern: ``(text_keys..., matched)``.

    ``matched`` is the array of the matching patterns' ``pat_keys`` as structs.
    """
    t = texts.select(*text_keys, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    proposed = proposals(texts, text_keys, text, pats, pat_keys, pat, table_bits)
    joined = t.join(proposed, _same(t, proposed, text_keys))
    held = F.filter("_prop", lambda x: F.contains(F.col("_text"), x["_pat"]))
    only = F.transform("_held", lambda x: F.struct(*[x[k].alias(k) for k in pat_keys]))
    return (joined.select(*text_keys, held.alias("_held")).filter(F.size("_held") > 0)
            .select(*text_keys, only.alias("matched")))


def contains_pairs(texts: DataFrame, text_keys: Sequence[str], text: str,
                   pats: DataFrame, pat_keys: Sequence[str], pat: str) -> DataFrame:
    """Distinct ``(text_keys..., pat_keys...)`` where ``text`` contains ``pat``."""
    m = matches(texts, text_keys, text, pats, pat_keys, pat)
    return m.select(*text_keys, F.explode("matched").alias("_m")).select(*text_keys, "_m.*").distinct()


def contains_any(texts: DataFrame, text_keys: Sequence[str], text: str, pats: DataFrame, pat: str) -> DataFrame:
    """Distinct ``text_keys`` of texts that contain any pattern (no pairs are formed)."""
    return matches(texts, text_keys, text, pats.select(pat).distinct(), [pat], pat).select(*text_keys).distinct()

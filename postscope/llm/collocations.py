"""Collocations: phrases of 2 to 4 words scored by their weakest cut, per language.

Only the longest windows are counted.  At every word the row holds four
columns, the word and its three followers (as ``lead`` gives them), padded where
the piece ends.  A phrase occurs exactly where a window begins with it, so the
counts of shorter phrases are sums over windows: Spark's ROLLUP adds up
successively shorter prefixes of the window counts.  No phrase length is
exploded by itself.

A word stands as a code of (language, word), so a window is four numbers and its
first code tells the language.  The word table (language, word, count) gives n,
turns codes back into words, and proves that no two words share a hash; if two
do, the next hash base is taken.  The most frequent 2^``DENSE`` - 1 words have
their rank as code, all others their hash (a negative number): windows of
frequent words are shuffled in two numbers instead of four, all others in four.

A phrase with a word or a prefix that occurs fewer than ``least`` times occurs
fewer times itself.  So a window is padded from its first rare word on.  The
first ROLLUP, over all windows, sums prefixes of one and two words; the second,
prefixes of three, over windows without a rare pair in them; four words are the
window itself.  The tests use bit
tables of fixed size (2^``BITS`` bits, 8 MB) that may keep too much but never
too little; counts are exact, and a count below ``least`` is dropped in the end.

Score of a cut after k words: floor(2000000 a / (l + r)), in decimals.  The
lowest cut counts (ties: least k).  A candidate inside a longer candidate that
has at least ``covered`` per cent of its count is dropped, whether or not the
longer one is dropped itself.

Defined cases: null text is empty; null language is ``und``; a word of any
length is a word; a piece of any length is cut into windows whole; equal scores
and counts are ranked by the phrase in UTF-8 byte order; repeated rows count as
often as they stand; an empty table gives no rows; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_n_per_group
from .common import BASE, LOWER, mix, pick, prefix_hash, slices, span_hash, staged, utf8

LEAST, COVERED, TOP = 30, 80, 2_000
BITS = 26
DENSE = 20
SLICE = 1 << 21
PER_MILLION = 2_000_000
_H = ["h1", "h2", "h3", "h4"]

_SPLIT = np.zeros(256, bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE = _SPLIT.copy()
_SPACE[list(b" \t")] = True


class Tokens:
    """Words of lower-cased texts: place, code, and whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: list[str], base: int):
        self.low = low = LOWER[data]
        word = ~_SPACE[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[off] = True
        before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        piece = np.cumsum(_SPLIT[low])[self.start] if len(self.start) else np.empty(0, np.int64)
        self.follows = np.zeros(len(self.start), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        salt = {lang: np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
                for lang in set(langs)}
        salts = np.array([salt[x] for x in langs], np.uint64)
        code = mix(span_hash(prefix_hash(low, base), self.start, self.end, base) ^ salts[self.doc]) if len(self.start) \
            else np.empty(0, np.uint64)
        self.code = code | np.uint64(1 << 63)       # as a long it is negative; 0 is the padding


def _texts(batches, base: int):
    for b in batches:
        langs = b.column(0).to_pylist()
        data, off = utf8(b.column(1))
        for i, j in slices(off, SLICE):
            t = Tokens(data[off[i]:off[j]], off[i:j + 1] - off[i], langs[i:j], base)
            if len(t.start):
                yield langs[i:j], t


def _words(base: int):
    def run(batches):
        for langs, t in _texts(batches, base):
            code, at, n = np.unique(t.code, return_index=True, return_counts=True)
            low = t.low.tobytes()
            words = [low[s:e].decode() for s, e in zip(t.start[at].tolist(), t.end[at].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[d] for d in t.doc[at].tolist()], pa.string()), pa.array(code.view(np.int64)),
                 pa.array(words, pa.string()), pa.array(n.astype(np.int64))], ["lang", "code", "word", "n"])
    return run


def _slot(*codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = mix(h * np.uint64(BASE) + c.view(np.uint64))
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _marks(columns: int):
    def run(batches):
        for b in batches:
            slot = _slot(*(b.column(i).to_numpy() for i in range(columns)))
            bit = np.left_shift(np.int64(1), slot & 63)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(bit)], ["slot", "bit"])
    return run


def _bit_table(rows: DataFrame) -> np.ndarray:
    """Bits of fixed size: set for every row.  The driver gets at most 2^``BITS`` / 64 numbers."""
    marked = rows.mapInArrow(_marks(len(rows.columns)), "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    got = marked.toArrow()
    bits = np.zeros((1 << BITS) // 64, np.int64)
    bits[got.column("slot").to_numpy()] = got.column("bit").to_numpy()
    return bits


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


class Ranks:
    """Codes of words from their hashes: the rank of the most frequent ones, else the hash."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at] + 1, hashes)


_PACKED = 1 << 62
_LOW = (1 << DENSE) - 1


def _packed(w: np.ndarray) -> np.ndarray:
    """Windows of ranks: three words in the first number, the fourth in the second; others stay."""
    small = (w >= 0).all(0)
    one = np.int64(_PACKED) | w[0] << np.int64(2 * DENSE) | w[1] << np.int64(DENSE) | w[2]
    zero = np.int64(0)
    return np.stack([np.where(small, one, w[0]), np.where(small, w[3], w[1]), np.where(small, zero, w[2]), np.where(small, zero, w[3])])


def _unpacked() -> list[Column]:
    small = F.col("h1") >= _PACKED

    def place(shift: int) -> Column:
        return F.shiftright("h1", shift).bitwiseAND(F.lit(_LOW).cast("long"))
    return [F.when(small, place(2 * DENSE)).otherwise(F.col("h1")).alias("h1"), F.when(small, place(DENSE)).otherwise(F.col("h2")).alias("h2"),
            F.when(small, place(0)).otherwise(F.col("h3")).alias("h3"), F.when(small, F.col("h2")).otherwise(F.col("h4")).alias("h4")]


def _windows(base: int, bits, ranks):
    def run(batches):
        known = bits.value
        for _, t in _texts(batches, base):
            some, back = np.unique(t.code.view(np.int64), return_inverse=True)
            code = np.where(_has(known, _slot(some)), ranks.value.codes(some), 0)[back]
            lead = [code]
            for _ in range(3):      # the next word's shorter window, where that word follows
                last = np.zeros(len(code), np.int64)
                last[:-1] = np.where(t.follows[:-1], lead[-1][1:], 0)
                lead.append(last)
            for k in range(1, 4):   # a window ends at its first padding
                lead[k] = np.where(lead[k - 1] == 0, 0, lead[k])
            w = _packed(np.stack([c[code != 0] for c in lead]))
            w = w[:, np.lexsort(w[::-1])]
            if not w.shape[1]:
                continue
            first = np.flatnonzero(np.concatenate(([True], (w[:, 1:] != w[:, :-1]).any(0))))
            n = np.diff(np.append(first, w.shape[1]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in w), pa.array(n.astype(np.int64))], [*_H, "n"])
    return run


def _coded(ranks):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranks.value.codes(b.column(1).to_numpy())), b.column(2)], ["lang", "code", "word"])
    return run


def _of_pairs(bits):
    def run(batches):
        known = bits.value
        for b in batches:
            h1, h2, h3 = (b.column(i).to_numpy() for i in range(3))
            yield b.filter(pa.array(_has(known, _slot(h1, h2)) & _has(known, _slot(h2, h3))))
    return run


def word_table(own: DataFrame, base: int) -> DataFrame:
    """(lang, code, word, n) of all words; raises ``LookupError`` if two words share a code."""
    words = own.mapInArrow(_words(base), "lang string, code long, word string, n long")
    words = staged(words.groupBy("lang", "code", "word").agg(F.sum("n").alias("n")), "collocation-words")
    if words.groupBy("code").count().filter("count > 1").limit(1).count():
        raise LookupError("two words share a code")
    return words


def phrase_counts(docs: DataFrame, text: Column | str = "text", lang: Column | str = "lang",
                  least: int = LEAST, ranked: int = _LOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, code, word), (totals: lang, n) and phrases of 1 to 4 words as codes h1..h4 (0: none) with their
    count ``a``; words and phrases that occur ``least`` times."""
    own = pick(docs, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    base = BASE
    while True:
        try:
            words = word_table(own, base)
            break
        except LookupError:
            base = (base * 5 + 2) % (1 << 64)       # odd stays odd
    sc = docs.sparkSession.sparkContext
    often = words.filter(F.col("n") >= least)
    first = often.select("n", "code").orderBy(F.desc("n"), "code").limit(ranked).select("code").toArrow()
    ranks = sc.broadcast(Ranks(first.column("code").to_numpy()))
    marks = sc.broadcast(_bit_table(often.select("code")))
    windows = own.mapInArrow(_windows(base, marks, ranks), "h1 long, h2 long, h3 long, h4 long, n long")
    longest = staged(windows.groupBy(*_H).agg(F.sum("n").alias("n")).select(*_unpacked(), "n"), "collocation-windows")
    none = F.lit(0).cast("long")

    def rolled(rows: DataFrame, keys: list[str]) -> DataFrame:
        """ROLLUP over prefixes of the windows; the two longest prefixes, without padded ones."""
        up = rows.rollup(*keys).agg(F.sum("n").alias("a"), F.grouping_id().alias("level"))
        up = up.filter((F.col("a") >= least) & (F.col("level") <= 1))
        full, short = keys[-1], keys[-2]
        whole = F.when(F.col("level") == 0, F.col(full) != 0).otherwise(F.col(short) != 0)
        return up.filter(whole).select(*[F.coalesce(k, none).alias(k) if k in keys else none.alias(k) for k in _H], "a")

    short = staged(rolled(longest, _H[:2]), "collocation-pairs")
    pairs = sc.broadcast(_bit_table(short.filter("h2 <> 0").select("h1", "h2")))
    kept = longest.filter("h3 <> 0").mapInArrow(_of_pairs(pairs), longest.schema)
    # windows of four words are not summed further: they are the longest, and stand counted
    four = longest.filter((F.col("h4") != 0) & (F.col("n") >= least)).withColumnRenamed("n", "a")
    three = rolled(kept, _H[:3]).filter("h3 <> 0")
    phrases = staged(short.unionByName(three).unionByName(four), "collocation-phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    coded = often.select("lang", "code", "word").mapInArrow(_coded(ranks), "lang string, code long, word string")
    return coded, totals, phrases


def _codes(*cols: str) -> Column:
    return F.struct(*[(F.col(c) if c else F.lit(0).cast("long")).alias(h) for c, h in zip([*cols, "", "", ""], _H)])


def collocations(docs: DataFrame, text: Column | str = "text", lang: Column | str = "lang", least: int = LEAST,
                 covered: int = COVERED, top: int = TOP, ranked: int = _LOW) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    words, totals, phrases = phrase_counts(docs, text, lang, least, min(ranked, _LOW))
    candidates = phrases.filter("h2 <> 0")
    three, four = F.col("h3") != 0, F.col("h4") != 0
    big = "decimal(20,0)"

    # cut after k words: counts of both parts
    def cut(k: int, left: Column, right: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = F.array_compact(F.array(
        cut(1, _codes("h1"), _codes("h2", "h3", "h4")),
        F.when(three, cut(2, _codes("h1", "h2"), _codes("h3", "h4"))),
        F.when(four, cut(3, _codes("h1", "h2", "h3"), _codes("h4")))))
    parts = candidates.select(*_H, "a", F.explode(cuts).alias("c")).select(*_H, "a", "c.*")

    def count_of(side: str, name: str) -> DataFrame:
        return phrases.select(*[F.col(h).alias(f"{side}_{h}") for h in _H], F.col("a").alias(name))
    for side, name in (("left", "l"), ("right", "r")):
        flat = parts.select("*", *[F.col(f"{side}.{h}").alias(f"{side}_{h}") for h in _H]).drop(side)
        parts = flat.join(count_of(side, name), [f"{side}_{h}" for h in _H]).drop(*[f"{side}_{h}" for h in _H])
    score = F.expr(f"(cast(a as {big}) * {PER_MILLION}) div (cast(l as {big}) + cast(r as {big}))")
    scored = parts.groupBy(*_H, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # the largest count of a longer candidate around each phrase
    around = F.array_compact(F.array(
        _codes("h1", "h2"), _codes("h2", "h3"), F.when(four, _codes("h3", "h4")),
        F.when(four, _codes("h1", "h2", "h3")), F.when(four, _codes("h2", "h3", "h4"))))
    longer = (candidates.filter(three).select(F.explode(around).alias("p"), "a").select("p.*", "a")
              .groupBy(*_H).agg(F.max("a").alias("longer")))
    free = scored.join(longer, _H, "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(big) * 100 < F.col("a").cast(big) * covered))
    free = free.select(*_H, "a", "c.*")

    for i, h in enumerate(_H):
        word = words.select(F.col("code").alias(h), F.col("word").alias(f"w{i}"), *(["lang"] if not i else []))
        free = free.join(word, h, "left" if i > 1 else "inner")
    phrase = F.concat_ws(" ", *[f"w{i}" for i in range(4)])
    ranked = top_n_per_group(free.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"), ["lang"],
                             [-F.col("score"), -F.col("a"), F.col("phrase")], top, "rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

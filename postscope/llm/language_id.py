"""Language identification with segmentation-marginalised unigram models.

The vocabulary is a fixed public list of sub-word pieces, used whole.  Every
language has a probability per piece; the probability of a word is the sum, over
all ways to cut it into pieces, of the product of its pieces' probabilities (a
forward pass), and a text's is the product over its words.

The probabilities are learned by expectation-maximisation over all labelled
training texts.  Their words are counted once per language and the counts stored,
so that a round costs what the distinct words cost: tasks run forward and backward
passes and only expected counts per (piece, language) are shuffled and collected, a
number bounded by the vocabulary times the languages.  Rounds go on until one
raises the log-likelihood by less than ``GAIN`` of it, at most ``ROUNDS``.

A forward pass over a long unbroken word is cut into blocks.  A block maps the
forward values of the ``longest`` positions before it linearly to those of its last
ones; the maps of many blocks are computed together and applied in order, so that
a character costs the same in short and long words and the sum stays exact.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when no training row has a letter; a language without one is not learned.  Ties go to the smaller language
name.  Characters outside the vocabulary cost a fixed probability, the same in
all languages.  Very long texts are scored whole; in learning, a word of more than
``STRETCH`` characters counts as stretches of that many.  Repeated rows count as
often as they stand.  Kept columns named like a result (``lang_pred``, ``score``)
give way to it; one named like the text is kept.  More than ``MAX_LANGS`` languages
raise an error, since the model has a column for each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .common import BASE, mix, pick, remove

MARK = "▁"          # word start, as in the vocabulary file
UNKNOWN = 1e-7           # probability of a character outside the vocabulary
CHUNK = 20_000           # words per array operation
GAIN, ROUNDS = 0.02, 6   # of the log-likelihood per round of learning; most rounds
UNITS = 200_000          # words taken together in learning
STRETCH = 64             # longest word learned as one, in characters
LONG, BLOCK = 256, 16    # characters from which a word is scored in blocks; characters of a block
BLOCK_VALUES = 1 << 21   # forward values held for the blocks of one array operation
FILTER_BITS = 20         # of the table that tells substrings that are no piece
MAX_LANGS = 1000         # columns of the model
RESULTS = {"lang_pred": "string", "score": "double"}
NOT_LETTERS = {c: " " for c in range(128) if not chr(c).isalpha()}
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(model_path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model file, in file order."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        body = p.removeprefix(MARK)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (not body or body.isalpha()) \
                and p == p.lower():
            out.append(p)
    return out


def _piece_hash(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h = 0
        for c in p:
            h = (h * BASE + ord(c) + 1) & (1 << 64) - 1
        out[i] = h
    return mix(out)


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray       # sorted piece hashes
    probs: np.ndarray      # (pieces + 1, langs): pieces in key order, then unknown
    longest: int           # characters of the longest piece

    def __post_init__(self):
        self.seen = np.zeros(1 << FILTER_BITS, bool)  # most substrings are no piece: a look here before the search
        self.seen[self.keys >> np.uint64(64 - FILTER_BITS)] = True


def words_of(text: str) -> list[str]:
    return text.lower().translate(NOT_LETTERS).split()


def _by_length(units: list[str]):
    """(indexes, character matrix) of units of one length, in bounded chunks."""
    length = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts):
        n = int(length[group[0]]) if len(group) else 0
        step = max(1, CHUNK * 8 // max(n, 1))
        for i in range(0, len(group), step):
            part = group[i:i + step]
            text = "".join([units[k] for k in part])
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)


def _spans(chars: np.ndarray, m: Model):
    """(start, end, rows, piece index) for every substring that is a piece, and all single characters."""
    rows, n = chars.shape
    everyone, unknown = np.arange(rows), len(m.keys)
    for i in range(n):
        h = np.zeros(rows, np.uint64)
        for j in range(i, min(n, i + m.longest)):
            h = h * np.uint64(BASE) + (chars[:, j].astype(np.uint64) + np.uint64(1))
            key = mix(h)
            some = np.flatnonzero(m.seen[key >> np.uint64(64 - FILTER_BITS)])
            at = np.searchsorted(m.keys, key[some])
            at[at == len(m.keys)] = 0
            right = m.keys[at] == key[some] if len(some) else np.zeros(0, bool)
            some, at = some[right], at[right]
            if i == j:
                single = np.full(rows, unknown)
                single[some] = at
                yield i, j + 1, everyone, single
            elif len(some):
                yield i, j + 1, some, at


def _forward(chars: np.ndarray, m: Model):
    """(log probability per row and language) of short units."""
    rows, n = chars.shape
    alpha = np.zeros((n + 1, rows, len(m.langs)))
    alpha[0] = 1.0
    scale = np.zeros((rows, len(m.langs)))
    for i, j, some, at in _spans(chars, m):
        if j == i + 1 and i and i % 16 == 0:  # first span from a new start: alpha[i] is complete
            f = np.maximum(alpha[i], 1e-280)
            scale += np.log(f)
            for k in range(i, min(n, i + m.longest) + 1):
                alpha[k] /= f
        alpha[j][some] += alpha[i][some] * m.probs[at]
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale


def _in_blocks(chars: np.ndarray, m: Model) -> np.ndarray:
    """Log probability per language of one long unit, from the linear maps of its blocks."""
    width, langs = m.longest, len(m.langs)
    blocks = -(-len(chars) // BLOCK)
    padded = np.zeros(width - 1 + blocks * BLOCK, np.uint32)
    padded[width - 1:width - 1 + len(chars)] = chars
    windows = np.lib.stride_tricks.sliding_window_view(padded, width - 1 + BLOCK)[::BLOCK]
    last = len(chars) - (blocks - 1) * BLOCK  # characters of the last block
    state = np.zeros((langs, width, 1))       # forward values of the positions up to the block's start
    state[:, -1] = 1.0
    scale = np.zeros(langs)
    step = max(1, BLOCK_VALUES // ((width + BLOCK) * width * langs))
    for first in range(0, blocks, step):
        part = windows[first:first + step]
        maps = np.zeros((width + BLOCK, len(part), width, langs))
        maps[range(width), :, range(width)] = 1.0
        for i, j, some, at in _spans(part, m):
            if j >= width:
                maps[j][some] += maps[i][some] * m.probs[at][:, None, :]
        for r in range(len(part)):
            end = last if first + r == blocks - 1 else BLOCK
            state = np.matmul(maps[end:end + width, r].transpose(2, 0, 1), state)
            f = np.maximum(state.max(1, keepdims=True), 1e-300)
            state /= f
            scale += np.log(f[:, 0, 0])
    return np.log(np.maximum(state[:, -1, 0], 1e-300)) + scale


def word_logprobs(words: list[str], m: Model) -> np.ndarray:
    """log P(word | language), all segmentations summed."""
    out = np.zeros((len(words), len(m.langs)))
    for part, chars in _by_length([MARK + w for w in words]):
        if chars.shape[1] > LONG:
            for k, row in zip(part, chars):
                out[k] = _in_blocks(row, m)
        else:
            out[part] = _forward(chars, m)
    return out


def _expected(units: list[str], counts: np.ndarray, m: Model, total: np.ndarray) -> float:
    """Add the expected piece counts of ``units`` (of one language) to ``total``; their log-likelihood."""
    fit = 0.0
    for part, chars in _by_length(units):
        rows, n = chars.shape
        spans = list(_spans(chars, m))
        alpha = np.zeros((n + 1, rows))
        beta = np.zeros_like(alpha)
        alpha[0] = beta[n] = 1.0
        prob = m.probs[:, 0]
        for i, j, some, at in spans:
            alpha[j][some] += alpha[i][some] * prob[at]
        for i, j, some, at in reversed(spans):
            beta[i][some] += beta[j][some] * prob[at]
        whole = np.maximum(alpha[n], 1e-300)
        fit += float((counts[part] * np.log(whole)).sum())  # not a dot product: its threads spin
        weight = counts[part] / whole
        share = [alpha[i][some] * beta[j][some] * prob[at] * weight[some] for i, j, some, at in spans]
        total += np.bincount(np.concatenate([s[3] for s in spans]), np.concatenate(share), len(total) + 1)[:-1]
    return fit


def _counter(batches):
    """(unit, lang, n) of the batch's words, each with its start mark, long ones in stretches."""
    for b in batches:
        seen: dict[str, Counter] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in seen.items():
            units: Counter = Counter()
            for w, n in found.items():
                w = MARK + w
                for k in range(0, len(w), STRETCH):
                    units[w[k:k + STRETCH]] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(units), pa.string()), pa.array([lang] * len(units), pa.string()),
                 pa.array(list(units.values()), pa.int64())], names=["unit", "lang", "n"])


def _held(batches, rows: int):
    """Lists of batches of at least ``rows`` rows (the last one of fewer): array operations need many words of a length."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if n:
        yield held


def _learner(shared):
    def learn(batches):
        m: Model = shared.value
        for held in _held(batches, UNITS):
            t = pa.Table.from_batches(held)
            for q, lang in enumerate(m.langs):
                mine = t.filter(pc.equal(t["lang"], lang))
                if mine.num_rows:
                    total = np.zeros(len(m.keys))
                    fit = _expected(mine["unit"].to_pylist(), mine["n"].to_numpy().astype(float),
                                    Model([lang], m.keys, m.probs[:, q:q + 1], m.longest), total)
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(  # piece -1: the log-likelihood
                        [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.full(len(at) + 1, q, np.int32)),
                         pa.array(np.append(total[at], fit))], names=["piece", "lang", "n"])
    return learn


def fit(docs: DataFrame, pieces: list[str], rounds: int = ROUNDS, text: str = "text", lang: str = "lang",
        smooth: float = 0.05, gain: float = GAIN) -> Model:
    """Learn piece probabilities per language from all rows with a text and a language."""
    spark = docs.sparkSession
    keys = np.unique(_piece_hash(pieces))
    longest = max(map(len, pieces), default=1)
    d = pick(docs, text=text, lang=lang).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    path = scratch_path(spark, "language-words")
    # few bytes, but the work of a round: dealt over all tasks
    (d.mapInArrow(_counter, "unit string, lang string, n long").groupBy("unit", "lang").agg(F.sum("n").alias("n"))
     .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit", "lang").write.parquet(path))
    words = spark.read.schema("unit string, lang string, n long").parquet(path)
    langs = sorted(r[0] for r in words.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    tail = np.full((1, max(1, len(langs))), UNKNOWN)
    flat = np.full((len(keys), max(1, len(langs))), 1.0 / max(1, len(keys)))
    m = Model(langs, keys, np.vstack([flat, tail]), longest)
    before = -np.inf
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(m)
        got = (words.mapInArrow(_learner(shared), "piece int, lang int, n double")
               .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())
        shared.destroy()
        piece, of, n = (got[c].to_numpy() for c in ("piece", "lang", "n"))
        counts = np.full((len(keys), len(langs)), smooth)
        counts[piece[piece >= 0], of[piece >= 0]] += n[piece >= 0]
        m = Model(langs, keys, np.vstack([counts / counts.sum(0), tail]), longest)
        now = float(n[piece < 0].sum())
        if now - before < gain * abs(now):
            break
        before = now
    remove(spark, [path])
    return m


def _scorer(shared):
    def score(batches):
        m: Model = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            pred: list[str] = ["und"] * len(texts)
            prob = np.zeros(len(texts))
            if m.langs:
                for i in range(0, len(texts), 2000):
                    _score_some(texts[i:i + 2000], i, m, pred, prob)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(prob)],
                                             names=[*b.schema.names[:-1], "lang_pred", "score"])
    return score


def _score_some(texts, base, m, pred, prob) -> None:
    split = [words_of(t) if t else [] for t in texts]
    at: dict[str, int] = {}
    for ws in split:
        for w in ws:
            if w not in at:
                at[w] = len(at)
    logs = word_logprobs(list(at), m)
    for k, ws in enumerate(split):
        if not ws or not _LETTER.search(texts[k]):
            continue
        total = logs[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(0)
        best = int(total.argmax())
        pred[base + k] = m.langs[best]
        prob[base + k] = 1.0 / np.exp(np.maximum(total - total[best], -700)).sum()


def identify(docs: DataFrame, model: Model, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) plus ``lang_pred`` and ``score`` (posterior, 0 to 1)."""
    keep = {c: F.col(f"`{c}`") for c in docs.columns if c != text} if keep is None else keep
    keep = {k: c for k, c in keep.items() if k.lower() not in RESULTS}
    # under plain names in the tasks, since a kept column may have any name
    d = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(keep.values())], F.col(f"`{text}`").alias("t"))
    schema = StructType(d.schema.fields[:-1])
    for result, kind in RESULTS.items():
        schema = schema.add(result, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_scorer(shared), schema).toDF(*keep, *RESULTS)

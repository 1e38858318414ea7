"""F10 as a trained model: character trigram profiles of languages.

``learn_profiles`` counts the trigrams of labelled texts per language and keeps
each language's most frequent ones with whole-number log weights;
``detect_by_profile`` sums a text's weights per language in one aggregate.  Both
are built-in expressions only, and the model is a small table.

A text is read as its words: runs of at most 64 letters of the lower-cased text
(a longer run is several), each between two spaces, so that a word of n letters
has n trigrams.  Weights are thousandths of a natural logarithm, rounded: sums
are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_n_per_group
from .language import DEFAULT_LANG, LANG_ORDER

WORD = r"\p{L}{1,64}"
# trigrams kept per language: bounds the model, and with it what is broadcast
TOP = 400


def _words(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(WORD), 0)


def _grams(df: DataFrame, word: str, keep: Sequence[str]) -> DataFrame:
    """One row per trigram of ``word`` (none of a null word: one row with a null ``gram``)."""
    at = df.select(*keep, word, F.explode_outer(F.sequence(F.lit(1), F.length(word))).alias("_at"))
    return at.select(*keep, F.concat(F.lit(" "), word, F.lit(" ")).substr(F.col("_at"), F.lit(3)).alias("gram"))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang",
                   langs: Sequence[str] = LANG_ORDER, top: int = TOP) -> DataFrame:
    """The model: (gram, n_<lang>, w_<lang> per language), at most ``top`` x languages rows.

    ``n`` counts the trigram in all labelled texts, ``w`` is
    floor(1000 ln((n + 0.5) / (all trigrams of the language + 1)) + 0.5).  Words
    are counted before they are cut, so that the exchanges carry one row per
    word and task, then one per trigram.  Equal counts are kept in the order of
    the trigrams.  Rows with another label, or none, teach nothing.
    """
    labelled = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter(F.col("_lang").isin(list(langs)))
    words = (labelled.select("_lang", F.explode(_words("_text")).alias("_word"))
             .groupBy("_lang", "_word").agg(F.count("*").alias("_n")))
    counts = _grams(words, "_word", ["_lang", "_n"]).groupBy("_lang", "gram").agg(F.sum("_n").alias("_n"))
    every = counts.agg(F.struct(*[F.coalesce(F.sum(F.when(F.col("_lang") == x, F.col("_n"))), F.lit(0)).alias(x) for x in langs])
                       .alias("all")).scalar()
    kept = top_n_per_group(counts, ["_lang"], [F.desc("_n"), F.asc("gram")], top).select("gram").distinct()
    wide = (counts.join(kept, "gram", "left_semi").groupBy("gram")
            .agg(*[F.coalesce(F.sum(F.when(F.col("_lang") == x, F.col("_n"))), F.lit(0)).alias(f"n_{x}") for x in langs]))
    weight = lambda x: F.floor(F.lit(1000.0) * F.log((F.col(f"n_{x}") + F.lit(0.5)) / (every.getField(x) + 1)) + F.lit(0.5))
    return wide.select(
        "gram", *[F.col(f"n_{x}") for x in langs], *[weight(x).cast("long").alias(f"w_{x}") for x in langs])


def detect_by_profile(df: DataFrame, profiles: DataFrame, key: str | Sequence[str] = "media_id", text: str = "caption",
                      langs: Sequence[str] = LANG_ORDER, default: str = DEFAULT_LANG) -> DataFrame:
    """(key, lang, margin): the language whose weights sum highest.

    ``margin`` is the lead over the runner-up in thousandths of a logarithm.  A
    tie goes to the earlier language of ``langs``; a text without a known
    trigram (null, empty, no letters, other scripts) is ``default`` with margin
    0.  Rows of an equal key are read as one text.  The texts are not shuffled:
    the trigrams meet the broadcast model (its size is bounded by ``TOP``) and
    one row of sums per key and task goes to the exchange.
    """
    keys = [key] if isinstance(key, str) else list(key)
    words = df.select(*keys, F.explode_outer(_words(text)).alias("_word"))
    model = profiles.select("gram", *[F.col(f"w_{x}") for x in langs])
    sums = (_grams(words, "_word", keys).join(F.broadcast(model), "gram", "left")
            .groupBy(*keys).agg(*[F.sum(f"w_{x}").alias(f"_s_{x}") for x in langs]))
    scores = [F.col(f"_s_{x}") for x in langs]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    pick = reduce(lambda c, x: c.when(F.col(f"_s_{x}") == best, F.lit(x)), langs, F.when(best.isNull(), F.lit(default)))
    second = F.sort_array(F.array(*scores), asc=False)[1] if len(scores) > 1 else best
    return sums.select(*keys, pick.alias("lang"), F.coalesce(best - second, F.lit(0)).cast("long").alias("margin"))

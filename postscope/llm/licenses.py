"""Licence notices: a trained notice classifier, confirmed by templates.

Training notices are variants of fixed notice templates (words left out by a
hash) and of sentences that only mention licences.  Features are word unigrams
and bigrams; a softmax regression over the licence families and ``other`` starts
from naive Bayes log ratios and takes full-batch gradient steps, all as
DataFrame joins and grouped sums.  Half of the variants calibrate the unknown
class: set into ``PROSE`` and searched as documents are, they give the bound, the
``CALIBRATE`` quantile of the right family's probability; a prediction below it is
no notice of that family.  Sums are scaled by the number of features the model
knows, so words around a notice change nothing.

Documents are cut into paragraphs at blank lines, so wrapped lines are joined.
A notice holds ``MIN_SHARED`` of the distinct words of a template.  Every template
has anchors, so many of its words that a notice cannot miss them all
(``_anchors``); words around anchors are kept, and leaving the others out loses
no notice.  Equal kept passages are judged once.  At every anchor each template
that holds it is laid over the passage: windows of the template's own size (a
quarter longer) and of ``WINDOW`` words.  A window is a notice if it shares enough
words with the template and the classifier gives the template's family.  Of
overlapping ones the best is kept.  A passage that looks like a notice (a
``TRIGGERS`` word, or two neighbouring content words of a template) away from the
kept ones, and that the classifier does not call ``other``, is ``unknown``.
DataFrame operations only.

Defined cases: null or empty texts have no notice; repeated rows are separate
rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, staged

# fixed values: short public licence notices by family
TEMPLATES = [
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You can redistribute it under the terms of the GNU Affero General Public License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the Apache License. You may obtain a copy of the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("cc0", "Licensed under CC0 1.0 Universal, dedicated to the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright to this work under CC0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "Copyright by the author. All rights reserved. No part may be reproduced without a written license."),
    ("agpl", "Released under the GNU AGPL v3."),
    ("apache", "Released under the Apache 2.0 License."),
    ("cc0", "This work is in the public domain."),
    ("cc0", "Dedicated to the public domain."),
    ("cc0", "This work is released under CC0 1.0."),
    ("gpl", "Released under the GNU GPL v3."),
    ("lgpl", "Released under the GNU LGPL v3."),
    ("mpl", "Released under the MPL 2.0."),
    ("proprietary", "All rights reserved."),
    ("other", "A driving license is required for this work."),
    ("other", "The license fee is due at the end of the month."),
    ("other", "She was licensed to practise medicine in the state."),
    ("other", "The copyright office is open on the first day of the week."),
    ("other", "Renew your fishing license before the season."),
    ("other", "The court said that copyright does not protect ideas."),
    ("other", "He took poetic license with the story of the city."),
    ("other", "The bar lost its license to sell wine in public."),
    ("other", "All rights of the people are the same in this land."),
    ("other", "The museum is open to the general public on every day."),
    ("other", "A table was reserved for the work in the public house."),
    ("other", "The new film was released in the city and is in the cinema."),
]
# fixed values: a passage with one of them looks like a notice
TRIGGERS = ["licen", "copyright"]
# fixed values: words too common to search for, unless a template has too few others
COMMON = set("a all an and any are as at be by can for from has in is it may no not of on or that the this to under with you".split())
# fixed value: calibration notices stand between two copies of it, each as long as a window
PROSE = ("in the morning the river was still and the old boat lay by the wall where the children used to sit and talk about "
         "the summer and the long road to the hills and when the rain came they went home to eat bread and listen to stories "
         "of the sea that their mother told them in the kitchen before the lamp was put out")
VARIANTS = 8
STEPS = 12
RATE = 0.4
WINDOW = 60
NEAR = 12              # words on each side of a notice-like word
CALIBRATE = 0.05
MIN_SHARED = 0.6       # of a template's words that a confirmed notice holds
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


def _features(w: str) -> Column:
    """Distinct words and word pairs."""
    return F.expr(f"array_distinct(concat({w}, if(size({w}) > 1, "
                  f"transform(sequence(1, size({w}) - 1), i -> concat({w}[i - 1], ' ', {w}[i])), array())))")


def _listed(df: DataFrame, key: str) -> DataFrame:
    """(key, f, v): one row per feature; v is its scale if the model knows all of them, as in training."""
    return (df.withColumn("fs", _features("words")).filter("size(fs) > 0")
            .select(key, F.explode("fs").alias("f"), (1 / F.sqrt(F.size("fs"))).alias("v")))


def _probabilities(x: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, family, p): softmax over the families of weights summed and scaled by the features the model knows."""
    z = x.join(weights, "f").groupBy(key, "family").agg((F.sum("w") / F.sqrt(F.count("*"))).alias("z"))
    top = Window.partitionBy(key)
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(top)))
    return e.select(key, "family", (F.col("e") / F.sum("e").over(top)).alias("p"))


@dataclass
class Model:
    weights: DataFrame      # f, family, w
    least: float            # smallest probability that is not unknown


def fit(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, steps: int = STEPS) -> Model:
    """Train on variants of the templates; bounded by their number."""
    rows = ", ".join("('{}', '{}')".format(f, t.replace("'", "''")) for f, t in templates)
    text = spark.sql(f"SELECT family, text, row_number() OVER (ORDER BY text) AS t FROM VALUES {rows} AS v(family, text)")
    variant = text.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("all", _words(F.col("text")))
    # variant 0 is whole; the others leave out about one word in six
    words = F.expr("filter(all, (w, i) -> v = 0 or pmod(xxhash64(w, i, v, t), 6) <> 0)")
    made = staged(variant.select("family", "v", (F.col("t") * VARIANTS + F.col("v")).alias("pid"), words.alias("words")), "notices")
    train, held = made.filter("v % 2 = 0"), made.filter("v % 2 = 1")
    x = staged(_listed(train, "pid").join(train.select("pid", "family"), "pid"), "notice-features")
    families = F.explode(F.array(*[F.lit(f) for f in sorted({f for f, _ in templates})]))
    # naive Bayes start: smoothed log share of each feature by family, around its mean
    base = (x.select("f").distinct().select("f", families.alias("family"))
            .join(x.groupBy("f", "family").agg(F.count("*").alias("n")), ["f", "family"], "left")
            .join(x.groupBy("family").agg(F.countDistinct("pid").alias("m")), "family"))
    share = F.log((F.coalesce("n", F.lit(0)) + 0.2) / (F.col("m") + 0.4))
    w = staged(base.withColumn("s", share).select(
        "f", "family", (F.col("s") - F.avg("s").over(Window.partitionBy("f"))).alias("w")), "weights")
    for k in range(steps):
        p = _probabilities(x.select("pid", "f", "v"), w, "pid").join(train.select("pid", F.col("family").alias("y")), "pid")
        slope = (x.select("pid", "f", "v").join(p, "pid").groupBy("f", "family")
                 .agg(F.sum(F.col("v") * (F.col("p") - (F.col("family") == F.col("y")).cast("double"))).alias("g")))
        w = w.join(slope, ["f", "family"]).select("f", "family", (F.col("w") * 0.999 - RATE * F.col("g")).alias("w"))
        if k % 3 == 2 or k == steps - 1:
            w = staged(w, "weights")
    around = F.split(F.lit(PROSE), " ")
    notes = held.filter("family <> 'other'")
    windows = _windows(notes.select(F.col("pid").alias("wid"), F.concat(around, "words", around).alias("words")), templates)
    right = _judged(windows, w).filter("guess = family").groupBy("wid").agg(F.max("p").alias("p"))
    least = right.agg(F.percentile("p", F.lit(CALIBRATE))).first()[0]
    return Model(w, float(least))


def _plain(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _anchors(notice: str) -> tuple[int, set[str]]:
    """Distinct words a notice must share with the template, and words of which it then holds one.

    It misses at most ``k - need`` of the ``k`` words, so ``k - need + 1`` of them are enough.
    """
    distinct = list(dict.fromkeys(_plain(notice)))
    need = math.ceil(MIN_SHARED * len(distinct) - 1e-9)
    content = [w for w in distinct if w not in COMMON]
    more = sorted((w for w in distinct if w in COMMON), key=len, reverse=True)
    return need, set(content + more[:max(0, len(distinct) - need + 1 - len(content))])


def _notices(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(f, t) for f, t in templates if f != "other"]


def _reach(templates: list[tuple[str, str]]) -> int:
    """Words on each side of an anchor that a window of it can hold."""
    return max([WINDOW, *(len(_plain(t)) for _, t in _notices(templates))]) + 3


def _listing(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def paragraphs(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``docs`` (rid, text, ...) by paragraph: ``par`` (null for a null text) and its ``passages`` (at, words) around anchors."""
    lone = _listing(set().union(*[_anchors(t)[1] for _, t in _notices(templates)]))
    like = " or ".join(f"contains(w, '{t}')" for t in TRIGGERS)
    reach = _reach(templates)
    cut = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode_outer(F.split("text", r"\n\s*\n")).alias("par", "body"))
    words = cut.withColumn("all", _words(F.col("body"))).drop("body")
    spots = words.withColumn("spots", F.expr(
        f"filter(transform(all, (w, i) -> if(w in ({lone}) or (length(w) > 4 and ({like})), i, -1)), i -> i >= 0)"))
    # runs of anchors: a longer gap than two reaches ends a passage
    edges = spots.withColumn("runs", F.expr(
        f"arrays_zip(filter(spots, (s, j) -> j = 0 or s - get(spots, j - 1) > {2 * reach}), "
        f"filter(spots, (s, j) -> j = size(spots) - 1 or get(spots, j + 1) - s > {2 * reach}))"))
    return edges.withColumn("passages", F.expr(
        f"transform(runs, r -> named_struct('at', greatest(r['0'] - {reach}, 0), 'words', "
        f"slice(all, greatest(r['0'] - {reach}, 0) + 1, r['1'] - greatest(r['0'] - {reach}, 0) + {reach} + 1)))")).drop("all", "spots", "runs")


def _windows(same: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(wid, kind, family, shared, low, high, words): windows to be judged of passages (wid, words).

    ``kind`` 0: of a template's size, 1: of ``WINDOW`` words, 2: around notice-like words;
    ``low``/``high``: the place the template itself would take, in wide windows up to its last anchor.
    """
    spark = same.sparkSession
    rows, pairs = [], set()
    for k, (f, t) in enumerate(_notices(templates)):
        all_words, (need, anchors) = _plain(t), _anchors(t)
        rows += [(w, f, k, q, len(all_words), need, sorted(set(all_words)), sorted(anchors)) for q, w in enumerate(all_words) if w in anchors]
        pairs |= {f"{a} {b}" for a, b in zip(all_words, all_words[1:]) if a not in COMMON and b not in COMMON}
    made = ", ".join("('{}', '{}', {}, {}, {}, {}, array({}), array({}))".format(*r[:6], _listing(r[6]), _listing(r[7])) for r in rows)
    known = spark.sql(f"SELECT * FROM VALUES {made} AS v(w, family, t, q, n, need, notice, lone)")
    placed = same.select("wid", "words", F.posexplode("words").alias("i", "w"))
    laid = (placed.join(F.broadcast(known), "w")     # the fixed templates
            .withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("from", F.greatest(F.col("i") - F.col("q") - 1, F.lit(0)))
            .withColumn("long", F.expr(f"if(kind = 0, n + 2 + n div 4, greatest({WINDOW}, n))").cast("int"))
            .withColumn("win", F.expr("slice(words, from + 1, long)"))
            .withColumn("n_shared", F.size(F.array_intersect("win", "notice"))).filter("n_shared >= need")
            .select("wid", "kind", "family", (F.col("n_shared") / F.size("notice")).alias("shared"), (F.col("i") - F.col("q")).alias("low"),
                    F.expr("if(kind = 0, i - q + n - 1, from + array_max(transform(win, (x, j) -> if(array_contains(lone, x), j, 0))))").alias("high"),
                    F.col("win").alias("words")))
    like = " or ".join(f"contains(w, '{t}')" for t in TRIGGERS)
    hint = placed.filter(F.expr(f"{like} or concat(w, ' ', get(words, i + 1)) in ({_listing(pairs)})")).select(
        "wid", F.lit(2).alias("kind"), F.lit("unknown").alias("family"), F.lit(0.0).alias("shared"), F.expr(f"i - {NEAR}").alias("low"),
        F.expr(f"i + {NEAR}").alias("high"), F.expr(f"slice(words, greatest(i - {NEAR}, 0) + 1, i + {NEAR} + 1 - greatest(i - {NEAR}, 0))").alias("words"))
    return laid.unionByName(hint).distinct()


def _judged(windows: DataFrame, weights: DataFrame) -> DataFrame:
    """``windows`` plus the classifier's ``guess`` and its ``p`` (none without a known feature)."""
    seen = staged(windows.withColumn("h", F.xxhash64("words")), "windows")
    texts = seen.select("h", "words").distinct().withColumn("nid", F.monotonically_increasing_id())
    texts = staged(texts, "window-texts")
    best = _probabilities(_listed(texts, "nid"), weights, "nid").groupBy("nid").agg(F.max_by("family", "p").alias("guess"), F.max("p").alias("p"))
    return seen.join(texts.join(best, "nid").select("h", "words", "guess", "p"), ["h", "words"]).drop("h", "words")


# a found notice of the same family must not touch, one of another not cover half of the shorter
_FREE = ("not exists(a, k -> least(k.high, x.high) >= greatest(k.low, x.low) and (x.kind = 2 or k.family = x.family "
         "or 2 * (least(k.high, x.high) - greatest(k.low, x.low) + 1) > least(k.high - k.low, x.high - x.low) + 1))")


def scan(found: DataFrame, model: Model, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(rid, par, at, family, p, shared), a row per notice in ``found`` (stored passages); ``family`` may be ``unknown``."""
    # equal passages are judged once, however many documents hold them
    same = staged(found.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "distinct-passages")
    judged = _judged(_windows(same, templates), model.weights)
    right = judged.filter((F.col("guess") != "other") & ((F.col("kind") == 2) | ((F.col("guess") == F.col("family")) & (F.col("p") >= model.least))))
    # the best first; then those that are free of better ones
    order = F.array_sort(F.collect_list(F.struct("kind", (-F.col("shared")).alias("s"), (-F.col("p")).alias("q"), "low", "high", "family")))
    kept = right.groupBy("wid").agg(order.alias("o")).select("wid", F.explode(F.expr(
        f"aggregate(slice(o, 2, size(o)), slice(o, 1, 1), (a, x) -> if({_FREE}, concat(a, array(x)), a))")).alias("x"))
    notices = staged(kept.join(same, "wid").select("words", "x.family", (-F.col("x.q")).alias("p"), (-F.col("x.s")).alias("shared")), "passage-notices")
    return found.join(notices, "words").select("rid", "par", "at", "family", "p", "shared")


def license_families(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: sorted families, notices found, passages with notices of no known family."""
    d = pick(docs, doc_id=doc_id, text=text).withColumn("rid", F.monotonically_increasing_id())
    # one pass: every document's id, and the passages of its paragraphs
    rows = staged(paragraphs(d), "license-rows")
    found = rows.select("rid", "par", F.explode("passages").alias("x")).select("rid", "par", "x.at", "x.words")
    notices = scan(found, fit(docs.sparkSession))
    known = F.col("family") != "unknown"
    per = notices.groupBy("rid").agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(known, F.col("family"))))).alias("families"),
        F.count_if(known).alias("n_notices"), F.count_distinct(F.when(~known, F.struct("par", "at"))).alias("n_unknown"))
    none = F.lit(0).cast("long")
    return rows.filter("par is null or par = 0").select("rid", "doc_id").join(per, "rid", "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_notices", none).alias("n_notices"),
        F.coalesce("n_unknown", none).alias("n_unknown"))

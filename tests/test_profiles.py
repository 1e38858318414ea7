"""The trained language model against plain sums, and the shape of its plan."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from postscope.functions.profiles import detect_by_profile, learn_profiles

LANGS = ["en", "es", "fr", "de"]
TEACH = [("the cat and the dog", "en"), ("this is the house of the king", "en"), ("el perro y los gatos", "es"),
         ("una casa para los niños", "es"), ("le chat et les chiens", "fr"), ("der Hund und die Katze", "de"),
         (None, "de"), ("", "fr"), ("unlabelled words", None), ("cosa nostra", "it")]
ASK = [("a", "The KING and the cats"), ("b", "los perros, una gata"), ("c", "les chats"), ("d", "und der Hunde"), ("e", None),
       ("f", ""), ("g", "1234 !?"), ("h", "日本語"), ("i", "x" * 5000), (None, "les chiens"), ("j", "d"), ("k", "the" * 60)]


def grams(text):
    out = []
    for word in re.findall(r"[^\W\d_]{1,64}", (text or "").lower()):
        out += [f" {word} "[i:i + 3] for i in range(len(word))]
    return out


def by_hand(top):
    n = {x: Counter(g for t, lang in TEACH if lang == x for g in grams(t)) for x in LANGS}
    kept = {g for c in n.values() for g, _ in sorted(c.items(), key=lambda e: (-e[1], e[0]))[:top]}
    return {g: [math.floor(1000 * math.log((n[x][g] + 0.5) / (sum(n[x].values()) + 1)) + 0.5) for x in LANGS] for g in kept}


def answer(text, model):
    sums = [sum(c) for c in zip(*[model[g] for g in grams(text) if g in model])]
    if not sums:
        return "en", 0
    first, second = sorted(sums, reverse=True)[:2]
    return LANGS[sums.index(first)], first - second


def test_profiles_equal_plain_sums(spark):
    docs = spark.createDataFrame(TEACH, "text string, lang string").withColumn("gram", F.lit("clash"))
    posts = spark.createDataFrame(ASK, "media_id string, caption string").withColumn("lang", F.lit("clash"))
    for top in (5, 400):
        model = learn_profiles(docs, top=top)
        want = by_hand(top)
        assert {r["gram"]: [r[f"w_{x}"] for x in LANGS] for r in model.collect()} == want
        got = {r["media_id"]: (r["lang"], r["margin"]) for r in detect_by_profile(posts, model).collect()}
        assert got == {k: answer(t, want) for k, t in ASK}
    assert [got[k][0] for k in "abcdefgh"] == ["en", "es", "fr", "de", "en", "en", "en", "en"]


def test_profiles_of_nothing(spark):
    docs = spark.createDataFrame(TEACH, "text string, lang string")
    posts = spark.createDataFrame(ASK, "media_id string, caption string")
    assert learn_profiles(docs.limit(0)).count() == 0
    got = detect_by_profile(posts, learn_profiles(docs.limit(0))).collect()
    assert len(got) == len(ASK) and {(r["lang"], r["margin"]) for r in got} == {("en", 0)}
    assert detect_by_profile(posts.limit(0), learn_profiles(docs)).count() == 0


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = detect_by_profile(docs, learn_profiles(docs), "doc_id", "text")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    asked = plan[:plan.index("BroadcastExchange")]
    assert asked.count("Exchange hashpartitioning") == 1 and "partial_sum" in asked   # sums only
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_agreement_on_short_texts(spark):
    from __spark_entry__ import queries
    rows = queries()["language_agreement"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    n, profile, words = (sum(r[c] for r in rows) for c in ("n_pieces", "right_by_profile", "right_by_words"))
    assert profile / n > 0.95 and profile > words

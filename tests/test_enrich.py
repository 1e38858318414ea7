from datetime import datetime

from pyspark.sql import functions as F

from postscope.functions.language import detect_language, detect_languages
from postscope.operators.enrich import post_features, title_match
from postscope.schemas import AUTHORS, FOLLOWS, POSTS, SHELF


def _posts(spark, caps):
    return spark.createDataFrame([(m, "c", int(m), c, None, None, [], "s", datetime(2024, 1, 1)) for m, c in caps], POSTS)


def _shelf(spark):
    long_review = "r" * 250
    data = [
        ("u", 1, "  The Long Title  ", "a", "b1", 0, long_review),   # outer spaces; rating 0 -> absent
        ("u", 2, "long title", "a", "b2", 4, ""),                     # also matches post 1, later position
        ("u", 3, "", "a", "b3", 5, "x"),                              # empty title never matches
        ("u", 4, None, "a", "b4", 5, "x"),                            # null title never matches
        ("u", 5, "Dune", "a", "b5", 3, "good"),                       # shorter than q
    ]
    return spark.createDataFrame(data, SHELF)


def test_title_match(spark):
    p = _posts(spark, [("1", "I loved THE LONG TITLE so much"), ("2", ""), ("3", "dune!"), ("4", "nothing here")])
    got = {r["media_id"]: (r["position"], r["book_rating"], r["book_review"]) for r in title_match(p, _shelf(spark)).collect()}
    assert got == {"1": (1, None, "r" * 200), "3": (5, 3, "good")}


def test_title_match_two_readers(spark):
    """Two shelves with the same positions: each post meets its own reader's books only."""
    shelf = spark.createDataFrame([("u1", 1, "Dune", "a", "b", 4, ""), ("u2", 1, "Emma", "a", "b", 5, ""),
                                   ("u2", 2, "Dune", "a", "b", 2, "")], SHELF)
    p = _posts(spark, [("1", "dune and emma"), ("2", "emma")]).withColumn("owner", F.concat(F.lit("u"), "media_id"))
    rows = lambda df: sorted((r["media_id"], r["user_id"], r["position"], r["book_title"]) for r in df.collect())
    assert rows(title_match(p, shelf, reader="owner")) == [("1", "u1", 1, "Dune"), ("2", "u2", 1, "Emma")]
    assert rows(title_match(p, shelf)) == [("1", "u1", 1, "Dune"), ("1", "u2", 1, "Emma"), ("2", "u2", 1, "Emma")]


def test_language_and_features(spark):
    p = _posts(spark, [("1", "the cat and the dog"), ("2", "el perro y los gatos con una casa"),
                       ("3", "der Hund und die Katze"), ("4", "xyz"), ("5", "le chat et les chiens")])
    got = {r["media_id"]: r["lang"] for r in p.select("media_id", detect_language("caption").alias("lang")).collect()}
    assert got == {"1": "en", "2": "es", "3": "de", "4": "en", "5": "fr"}
    rel = {r["media_id"]: r["lang"] for r in detect_languages(p, "media_id", "caption").collect()}
    assert rel == got
    authors = spark.createDataFrame([(1, "u1", "User One"), (2, "u2", "User Two")], AUTHORS)
    follows = spark.createDataFrame([(0, 1), (9, 2)], FOLLOWS)
    f = {r["media_id"]: r for r in post_features(p, authors, follows, _shelf(spark), 0).collect()}
    assert f["1"]["is_following"] and f["1"]["relation"] == "known" and f["1"]["username"] == "u1"
    assert not f["2"]["is_following"] and f["2"]["route"] == "es" and f["3"]["route"] == "en"
    assert f["4"]["username"] is None and f["4"]["book_position"] is None


def test_substring_join_equals_brute_force(spark):
    """Patterns of every length class, emoji, '?' and null keys; also with a full gram table."""
    import random

    from postscope.operators import substring_join as J
    rnd = random.Random(9)
    alphabet = "abcdeé ñ😀?"
    texts = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    texts += [(None, "😀abc"), (None, "?abc and ab"), (200, None), (201, "x" * 5000 + "needle in it")]
    pats = [(j, "".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 9, 12])))) for j in range(60)]
    pats += [(100, "?abc"), (101, ""), (102, None), (103, "needle in"), (None, "?"), (104, "?abc")]
    t = spark.createDataFrame(texts, "tid int, text string")
    p = spark.createDataFrame(pats, "pid int, pat string")
    want = {(i, j) for i, tx in texts for j, pt in pats if tx and pt and pt in tx}
    for bits in (22, 7):
        m = J.matches(t, ["tid"], "text", p, ["pid"], "pat", table_bits=bits).collect()
        assert {(r["tid"], x["pid"]) for r in m for x in r["matched"]} == want
    got = [(r["tid"], r["pid"]) for r in J.contains_pairs(t, ["tid"], "text", p, ["pid"], "pat").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hit = {r["tid"] for r in J.contains_any(t, ["tid"], "text", p, "pat").collect()}
    assert hit == {i for i, _ in want}
    assert J.contains_pairs(t, ["tid"], "text", p.limit(0), ["pid"], "pat").count() == 0


def test_proposals_stay_flat_as_patterns_grow(spark):
    """Every text and every pattern holds the same common phrase; patterns grow 100 times."""
    import random

    from postscope.operators import substring_join as J
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = spark.createDataFrame([(i, f"{word()} the history of {word()} and {word()}") for i in range(300)], "tid int, text string")
    pats = [(j, f"the history of {word()}") for j in range(2000)]

    def proposed(n):
        p = spark.createDataFrame(pats[:n], "pid int, pat string")
        out = J.proposals(texts, ["tid"], "text", p, ["pid"], "pat").selectExpr("sum(size(_prop)) AS n").first()["n"]
        return out or 0
    few, many = proposed(20), proposed(2000)
    assert few <= 30 and many <= 30          # none of the 300 x 2000 pairs that share the phrase

from datetime import datetime

from conftest import rows
from helpers import make_actions, plan_text

from postscope.operators import screening as S
from postscope.schemas import POSTS, VERDICTS


def _posts(spark, recs):
    """recs: (media_id, author_id, caption, hashtags, search_tag)."""
    data = [(m, "c" + m, a, cap, None, None, tags, st, datetime(2024, 1, 1)) for m, a, cap, tags, st in recs]
    return spark.createDataFrame(data, POSTS)


def test_screens_and_decisions(spark):
    p = _posts(spark, [
        ("1", 5, "Big GIVEAWAYS today", ["sun"], "beach"),      # keyword inside a longer word
        ("2", 5, "plain", ["sun"], "giveaway_time"),              # keyword only in the searched tag
        ("3", 5, "plain", ["Travel"], "beach"),                   # avoid tag in another case
        ("4", 5, "plain", ["travelling"], "beach"),               # avoid tag as part of a longer tag: no hit
        ("5", 0, "plain", [], "beach"),                           # own post (viewer 0)
        ("6", 5, "plain", [], "beach"),                           # sensitive verdict
        ("7", 5, "plain", [], "beach"),                           # no verdict
        ("8", 5, "plain", None, "beach"),                         # already commented
    ])
    v = spark.createDataFrame([("6", "  Sensitive\nnudity "), ("7x", "safe")], VERDICTS)
    a = make_actions(spark, [(1, "2024-01-01 00:00:00", "comment", None, "x", "8"),
                             (2, "2024-01-01 00:00:00", "like", None, "x", "1")])
    got = {r["media_id"]: (r["like_eligible"], r["comment_eligible"], r["reason"])
           for r in S.decide(p, a, v, 0, avoid=["travel"], allow_sensitive=False).collect()}
    assert got == {"1": (False, False, "keyword"), "2": (True, False, "keyword"), "3": (True, False, "avoid_tag"),
                   "4": (True, True, "ok"), "5": (True, False, "own_post"), "6": (True, False, "sensitive"),
                   "7": (True, True, "ok"), "8": (True, False, "already_done")}
    allowed = {r["media_id"]: r["reason"] for r in S.decide(p, a, v, 0, avoid=["travel"]).collect()}
    assert allowed["6"] == "ok"
    pv = S.parse_verdict(v).filter("media_id = '6'").first()
    assert pv["sensitive"] and pv["description"] == "nudity"
    assert rows(S.funnel(S.decide(p, a, v, 0, avoid=["travel"])).filter("reason = 'keyword'"), "search_tag", "count") \
        == [("beach", 1), ("giveaway_time", 1)]


def test_history_joins_and_table_screen(spark):
    p = _posts(spark, [("1", 5, "a dog", ["x"], "s"), ("2", 5, "a cat", ["y"], "s"), ("3", 5, "", ["Dog"], "s")])
    a = make_actions(spark, [(1, "2024-01-01 00:00:00", "comment", None, "x", "2")])
    assert [r["media_id"] for r in S.not_yet(p, a, "comment", by=()).orderBy("media_id").collect()] == ["1", "3"]
    assert [r["media_id"] for r in S.already(p, a, "comment", by=()).collect()] == ["2"]
    terms = spark.createDataFrame([("keyword", "DOG"), ("avoid", "dog"), ("keyword", "zebra")], "kind string, term string")
    got = {r["media_id"]: (r["kw_hit"], r["avoid_hit"]) for r in S.screen_by_table(p, terms).collect()}
    assert got == {"1": (True, False), "2": (False, False), "3": (True, True)}


def test_history_is_per_account(spark):
    """Two accounts share posts: what one did never counts for the other."""
    p = spark.createDataFrame([(a, m) for a in ("A", "B", None) for m in ("1", "2")], "account string, media_id string")
    a = make_actions(spark, [(1, "2024-01-01 00:00:00", "comment", None, "A", "1"), (2, "2024-01-01 00:00:00", "like", None, "B", "2"),
                             (3, "2024-01-01 00:00:00", "like", None, "B", "1")])
    key = lambda r: (r["account"] or "", r["media_id"])
    assert sorted(map(key, S.not_yet(p, a, "comment").collect())) == [("", "1"), ("", "2"), ("A", "2"), ("B", "1"), ("B", "2")]
    assert sorted(map(key, S.already(p, a, "like").collect())) == [("B", "1"), ("B", "2")]
    flags = {key(r): (r["liked"], r["commented"]) for r in S.done_flags(p, a, {"like": "liked", "comment": "commented"}).collect()}
    assert flags == {("A", "1"): (False, True), ("A", "2"): (False, False), ("B", "1"): (True, False), ("B", "2"): (True, False),
                     ("", "1"): (False, False), ("", "2"): (False, False)}


def test_every_reason_occurs_in_the_fixture(spark):
    import __spark_entry__ as E
    got = E.queries()["decisions"](spark, "/root/testdata/sf0.01").collect()
    assert {r["reason"] for r in got} == set(S.REASONS)
    assert {r["like_eligible"] for r in got} == {True, False} == {r["comment_eligible"] for r in got}


def test_recent_per_tag_and_candidates(spark):
    data = [(str(i), "c", 1, "", None, None, [], "t" if i < 15 else "u", datetime(2024, 1, 1, 0, i)) for i in range(20)]
    p = spark.createDataFrame(data, POSTS)
    rec = S.recent_per_tag(p, 10)
    assert sorted(int(r["media_id"]) for r in rec.filter("search_tag = 't'").collect()) == list(range(5, 15))
    assert "WindowGroupLimit" in plan_text(rec)
    lists = spark.createDataFrame([("acc", "hashtags", 1, " t "), ("acc", "avoid", 2, "u")], "account string, list_name string, seq long, tag string")
    assert S.candidates(lists, p).count() == 10

import random

from pyspark.sql import functions as F

from postscope.operators import tags as T
from postscope.schemas import TAGS


def admit_model(raws, cap):
    """Sequential model of adding tags one by one to a capped list."""
    lst, out = [], []
    for raw in raws:
        t = raw.strip()
        if t.startswith("#"):
            t = t[1:]
        if not t:
            out.append("empty")
        elif not t.replace("_", "").isalnum():
            out.append("invalid")
        elif t.lower() in [h.lower() for h in lst]:
            out.append("duplicate")
        elif len(lst) >= cap:
            out.append("too_many")
        else:
            lst.append(t)
            out.append("ok")
    return out


def _df(spark, lists):
    data = [(acct, "hashtags", seq, raw) for acct, raws in lists.items() for seq, raw in enumerate(raws)]
    return spark.createDataFrame(data, TAGS)


def test_golden_tags(spark):
    raws = ["#Travel", " travel ", "##x", "___", "#", "a_b", "café", "²", "五",
            "é", "\tfoo "]
    raws += [f"t{i}" for i in range(30)]        # fills the list to 30 and beyond
    raws += ["t29"]                              # repeat of a tag refused for the cap
    got = {r["seq"]: (r["tag"], r["status"]) for r in T.admit_tags(_df(spark, {"a": raws}), 30).collect()}
    st = [got[i][1] for i in range(len(raws))]
    assert st[:11] == ["ok", "duplicate", "invalid", "invalid", "empty", "ok", "ok", "ok", "ok", "invalid", "ok"]
    assert got[10][0] == "foo"
    assert st == admit_model(raws, 30)
    assert st[-1] == "too_many" and st[-2] == "too_many"


def test_admit_matches_sequential_model(spark):
    rnd = random.Random(7)
    pool = ["a", "A", "b", "B", "ab", "aB", "#a", "##a", " a ", "", "#", "a-b", "_", "x_1", "é", "C", "c", "d"]
    lists = {f"acct{i}": [rnd.choice(pool) for _ in range(rnd.randint(0, 25))] for i in range(200)}
    for cap in (0, 1, 3, 6):
        got = {}
        for r in T.admit_tags(_df(spark, lists), cap).collect():
            got[(r["account"], r["seq"])] = r["status"]
        for acct, raws in lists.items():
            assert [got[(acct, s)] for s in range(len(raws))] == admit_model(raws, cap), (acct, cap)


def test_dedupe_remove_and_size(spark):
    df = _df(spark, {"a": ["#X", "x", "y", "bad-tag", "Y"], "b": ["z"]})
    assert sorted((r["account"], r["tag"]) for r in T.dedupe_tags(df).collect()) == [("a", "X"), ("a", "y"), ("b", "z")]
    lists = T.admitted(df)
    removals = lists.filter(F.col("tag") == "y").select("account", "list_name", "tag")
    clears = lists.filter(F.col("account") == "b").select("account", "list_name")
    left = T.remove_tags(lists, removals, clears)
    assert sorted(r["tag"] for r in left.collect()) == ["X"]
    # exact, case-sensitive removal: 'Y' does not remove 'y'
    rem2 = lists.filter(F.col("tag") == "y").select("account", "list_name", F.lit("Y").alias("tag"))
    assert sorted(r["tag"] for r in T.remove_tags(lists, rem2).collect()) == ["X", "y", "z"]
    assert sorted((r["account"], r["n"], r["label"]) for r in T.tag_list_size(lists).collect()) == [("a", 2, "2/30"), ("b", 1, "1/30")]

import random
from datetime import datetime, timedelta

from pyspark.sql import types as T

from helpers import plan_text
from postscope.operators.quota import apply_quota

SCHEMA = T.StructType([
    T.StructField("g", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("id", T.LongType()), T.StructField("media_id", T.StringType()),
    T.StructField("ok", T.BooleanType()), T.StructField("h", T.BooleanType()),
])
T0 = datetime(2024, 1, 1)


def quota_model(rows, cap):
    """Sequential walk: skip posts done before (history or success earlier in
    the run), stop attempting at ``cap`` successes; failures use no quota."""
    out = {}
    for g in sorted({r[0] for r in rows}, key=repr):
        n, done = 0, set()
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            _, _, rid, m, ok, h = r
            att = (not h) and n < cap and m not in done
            acc = att and ok
            if acc:
                n += 1
                done.add(m)
            out[rid] = (att, acc)
    return out


def _run(spark, rows, cap, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    res = apply_quota(df, cap, ["g"], **kw).collect()
    return {r["id"]: (r["attempted"], r["accepted"]) for r in res}


def test_quota_goldens(spark):
    rows = [
        ("r", T0, 1, "p1", False, False),                      # failure ...
        ("r", T0 + timedelta(seconds=1), 2, "p1", True, False),  # ... then success on the same post
        ("r", T0 + timedelta(seconds=2), 3, "p1", True, False),  # repeat after success: not attempted
        ("r", T0 + timedelta(seconds=3), 4, "p2", True, True),   # repeat from history
        ("r", T0 + timedelta(seconds=4), 5, "p3", True, False),  # second success: cap 2 reached
        ("r", T0 + timedelta(seconds=5), 6, "p4", False, False),  # after the cap: not attempted
    ]
    got = _run(spark, rows, 2)
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (False, False),
                   5: (True, True), 6: (False, False)}
    assert all(v == (False, False) for v in _run(spark, rows, 0).values())


def test_quota_matches_sequential_model(spark):
    rnd = random.Random(11)
    rows, rid = [], 0
    for g in range(300):
        for _ in range(rnd.randint(0, 12)):
            rid += 1
            m = f"p{rnd.randint(0, 5)}"
            rows.append((f"g{g}", T0 + timedelta(seconds=rnd.randint(0, 30)), rid, m,
                         rnd.random() < 0.7, m == "p0"))
    for cap in (1, 2, 3):
        assert _run(spark, rows, cap) == quota_model(rows, cap), cap


def test_top_n_salted_fallback_equals_plain(spark):
    """Above the WindowGroupLimit threshold the two-stage salted rank gives the same rows."""
    from postscope.plans.ranking import top_n_per_group
    df = spark.range(0, 3000).selectExpr("id % 3 AS g", "id", "(id * 7919) % 3001 AS v")
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    plain = {(r["g"], r["id"], r["rn"]) for r in top_n_per_group(df, ["g"], ["v", "id"], 50).collect()}
    try:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
        ranked = top_n_per_group(df, ["g"], ["v", "id"], 50)
        plan = plan_text(ranked)
        assert "_salt" in plan                      # the bucketed first rank is planned
        salted = {(r["g"], r["id"], r["rn"]) for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    assert salted == plain and len(plain) == 150


def test_quota_null_keys_form_one_group(spark):
    """Null run keys and null post ids are grouped as a window partition would."""
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        g = rnd.choice(["a", "b", None])
        m = rnd.choice(["p1", "p2", "p3", None])
        rows.append((g, T0 + timedelta(seconds=rnd.randint(0, 40)), i, m, rnd.random() < 0.6, False))
    groups = {r[0] for r in rows}
    for cap in (1, 3):
        want = {}
        for g in groups:
            want.update(quota_model([r for r in rows if r[0] == g], cap))
        assert _run(spark, rows, cap) == want, cap


def days_model(rows, cap):
    """Sequential walk over (account, date, ts, id, post, ok, h): an accepted post stays done on later days."""
    out, done, used = {}, set(), {}
    for acc, day, ts, rid, m, ok, h in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2], r[3])):
        att = not h and used.get((acc, day), 0) < cap and (acc, m) not in done
        if att and ok:
            done.add((acc, m))
            used[acc, day] = used.get((acc, day), 0) + 1
        out[rid] = (att, att and ok)
    return out


DAYS = "account string, date string, ts timestamp_ntz, id long, media_id string, ok boolean, h boolean"


def days_rows(rnd, n, days=30, posts=40):
    rows = []
    for i in range(n):
        ts = T0 + timedelta(minutes=rnd.randint(0, 60 * 24 * days - 1))
        acc = rnd.choice(["a", "a", "a", "b", None])
        m = rnd.choice([None, *[f"p{k}" for k in range(posts)]])
        rows.append((acc, ts.strftime("%Y-%m-%d"), ts, i, m, rnd.random() < 0.7, m == "p0"))
    return rows


def test_quota_remembers_over_30_days(spark):
    from postscope.operators.quota import quota_over_days
    for cap, seed in ((0, 1), (1, 2), (2, 3), (5, 4)):
        rows = days_rows(random.Random(seed), 900)
        got = quota_over_days(spark.createDataFrame(rows, DAYS), cap, ["account"], "date").collect()
        assert {r["id"]: (r["attempted"], r["accepted"]) for r in got} == days_model(rows, cap), cap


def test_accepted_once_on_two_days(spark):
    from postscope.operators.quota import quota_over_days
    rows = [("a", f"2024-01-0{d}", T0 + timedelta(days=d - 1), d, "p", True, False) for d in (1, 2)]
    got = quota_over_days(spark.createDataFrame(rows, DAYS), 2, ["account"], "date").collect()
    assert sorted((r["id"], r["accepted"]) for r in got) == [(1, True), (2, False)]


def test_the_walk_of_a_hot_account_is_bounded(spark):
    """Of a day's first successes at most cap * days reach the walk, cut before the exchange."""
    from postscope.operators.quota import quota_over_days
    out = quota_over_days(spark.createDataFrame(days_rows(random.Random(7), 50), DAYS), 2, ["account"], "date", days=3)
    assert "WindowGroupLimit" in plan_text(out) and "row_number(), 6, Partial" in plan_text(out)


def test_history_of_another_account_does_not_count(spark):
    from postscope.operators.quota import with_history
    c = spark.createDataFrame([("A", "p"), ("B", "p"), (None, "p")], "account string, media_id string")
    done = spark.createDataFrame([("A", "p")], "account string, media_id string")
    assert {r["account"]: r["h"] for r in with_history(c, done).collect()} == {"A": True, "B": False, None: False}

import random
from datetime import datetime, timedelta

from helpers import make_actions

from postscope.operators import audits as A


def _random_log(spark, n=400, seed=5):
    rnd = random.Random(seed)
    recs = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rnd.randint(0, 5 * 86400))
        recs.append((i, ts.strftime("%Y-%m-%d %H:%M:%S"), rnd.choice(["like", "comment", "error"]), None,
                     rnd.choice(["a", "b", "c"])))
    return make_actions(spark, recs), recs


def test_gap_audit_matches_brute_force(spark):
    df, recs = _random_log(spark)
    got = {r["id"]: (r["gap_us"], r["too_close"]) for r in A.gap_audit(df).collect()}
    want = {}
    for acct in "abc":
        mine = sorted((datetime.strptime(r[1], "%Y-%m-%d %H:%M:%S"), r[0]) for r in recs if r[4] == acct)
        prev = None
        for ts, rid in mine:
            gap = None if prev is None else int((ts - prev).total_seconds() * 1_000_000)
            want[rid] = (gap, gap is not None and gap < A.min_gap_seconds() * 1_000_000)
            prev = ts
    assert got == want
    assert A.min_gap_seconds() == 1309


def test_quota_audit_and_seeded_order(spark):
    df, recs = _random_log(spark, 300, 9)
    over = {r["id"] for r in A.quota_audit(df, 3).collect()}
    want = set()
    groups = {}
    for r in recs:
        key = (r[4], r[1][:10], r[2])
        groups.setdefault(key, []).append((r[1], r[0]))
    for g in groups.values():
        want |= {rid for _, rid in sorted(g)[3:]}
    assert over == want
    import hashlib
    got = {(r["account"], r["id"]): r["rn"] for r in A.seeded_order(df.select("id", "account"), "id", 7).collect()}
    for acct in "abc":
        ids = sorted((hashlib.md5(f"{r[0]}|7".encode()).hexdigest(), r[0]) for r in recs if r[4] == acct)
        assert [got[(acct, i)] for _, i in ids] == list(range(1, len(ids) + 1))


def test_hours_and_sample(spark):
    df = make_actions(spark, [(1, "2024-01-01 10:30:00", "like", None), (2, "2024-01-01 03:00:00", "like", None),
                              (3, "2024-01-01 23:59:59", "like", None)])
    assert sorted(r["id"] for r in A.active_hours(df).collect()) == [1, 3]
    # UTC 10:30 is 07:30 in Buenos Aires (UTC-3): outside the active hours
    assert sorted(r["id"] for r in A.active_hours(df, tz="America/Argentina/Buenos_Aires").collect()) == [3]
    assert sorted((r["hour"], r["count"]) for r in A.hour_profile(df).collect()) == [(3, 1), (10, 1), (23, 1)]
    big, recs = _random_log(spark, 300, 1)
    import hashlib
    want = {r[0] for r in recs if int(hashlib.md5(f"{r[0]}|42".encode()).hexdigest()[:8], 16) % 100 < 30}
    assert {r["id"] for r in A.hash_sample(big, "id", 30, 42).collect()} == want

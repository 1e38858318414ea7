from conftest import rows
from helpers import make_actions, plan_text

from postscope.operators import stats

AS_OF = "2024-01-31 00:00:00"


def test_history_cutoff_and_pivot(spark):
    a = make_actions(spark, [
        (1, "2024-01-24 00:00:00", "like", None),          # exactly at the cutoff: kept (no fraction)
        (2, "2024-01-23 23:59:59.999999", "like", None),   # one microsecond before: dropped
        (3, "2024-01-25 10:00:00.5", "comment", "t"),
        (4, "2024-01-25 11:00:00", "like", "t"),
        (5, "2024-01-27 09:00:00", "other", None),         # unknown type: own row in A4, zeros in A7
    ])
    hist = rows(stats.action_history(a, AS_OF))
    assert hist == sorted([("2024-01-24", "like", 1), ("2024-01-25", "comment", 1),
                           ("2024-01-25", "like", 1), ("2024-01-27", "other", 1)], key=repr)
    piv = rows(stats.history_pivot(a, AS_OF), "date", "like", "comment", "error")
    # 2024-01-26 has no rows: absent; error has no rows: 0
    assert piv == [("2024-01-24", 1, 0, 0), ("2024-01-25", 1, 1, 0), ("2024-01-27", 0, 0, 0)]


def test_tag_stats_and_top_tags(spark):
    recs = [(1, "2024-01-01 00:00:00", "like", None), (2, "2024-01-01 00:00:01", "like", ""),
            (3, "2024-01-01 00:00:02", "like", "Food"), (4, "2024-01-01 00:00:03", "like", "food"),
            (5, "2024-01-01 00:00:04", "error", "errs")]
    i = 10
    for k in range(12):          # 12 tags, each with 2 actions, so rank 10 is a tie
        for _ in range(2):
            recs.append((i, "2024-01-02 00:00:00", "comment", f"t{k:02d}"))
            i += 1
    a = make_actions(spark, recs)
    ts = rows(stats.tag_stats(a), "hashtag", "action_type", "count")
    assert ("", "like", 1) in ts and ("Food", "like", 1) in ts and ("food", "like", 1) in ts
    assert all(t is not None for t, _, _ in ts)
    top = [r["hashtag"] for r in stats.top_tags(a).collect()]
    assert top == [f"t{k:02d}" for k in range(10)]          # tie broken by tag
    piv = {r["hashtag"]: (r["like"], r["comment"], r["error"]) for r in stats.tag_pivot(a).collect()}
    assert piv["errs"] == (0, 0, 1)


def test_success_rate(spark):
    empty = make_actions(spark, [(1, "2024-01-01 00:00:00", "other", None)])
    r = stats.success_rate(empty).first()
    assert (r["success"], r["errors"], r["total"], r["success_pct"]) == (0, 0, 0, None)
    recs = [(i, "2024-01-01 00:00:00", "like", None) for i in range(4)]
    recs += [(10 + i, "2024-01-01 00:00:00", "comment", None) for i in range(3)]
    recs += [(20, "2024-01-01 00:00:00", "error", None), (21, "2024-01-01 00:00:00", "other", None)]
    r = stats.success_rate(make_actions(spark, recs)).first()
    assert (r["success"], r["errors"], r["total"], r["success_pct"], r["error_pct"]) == (7, 1, 8, 87.5, 12.5)


def test_counts_headline_rollup(spark):
    a = make_actions(spark, [(1, "2024-01-01 00:00:00", "like", None), (2, "2024-01-01 00:00:00", "error", None)])
    assert rows(stats.headline(a)) == [(1, 0)]
    assert dict(rows(stats.type_counts(a, total=True))) == {None: 2, "like": 1, "error": 1}


def test_latest_errors_tie_break(spark):
    a = make_actions(spark, [(i, "2024-01-01 00:00:00", "error", None) for i in range(15)])
    assert [r["id"] for r in stats.latest_errors(a, 3).collect()] == [14, 13, 12]


def test_plans_push_down_and_take_ordered(spark, tmp_path):
    from postscope.sources.actions import append_actions, read_actions
    a = make_actions(spark, [(i, f"2024-01-{1 + i % 28:02d} 00:00:00", "like", "t") for i in range(60)])
    path = str(tmp_path / "log")
    append_actions(a, path)
    log = read_actions(spark, path)
    plan = plan_text(log.transform(lambda d: stats.lookback(d, AS_OF)))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "PartitionFilters: [isnotnull(date" in plan
    top_plan = plan_text(stats.top_tags(log))
    assert "TakeOrderedAndProject" in top_plan
    err_plan = plan_text(stats.latest_errors(log))
    assert "TakeOrderedAndProject" in err_plan and "PushedFilters: [IsNotNull(action_type), EqualTo(action_type,error)]" in err_plan
    assert log.filter("date >= '2024-01-20'").count() == len([i for i in range(60) if 1 + i % 28 >= 20])

import random
from datetime import datetime, timedelta

from helpers import make_actions

from postscope.plans.flows import screening_run, statistics_view
from postscope.schemas import POSTS, VERDICTS

TERMS = ("giveaway",)


def run_model(params, posts, history, viewers, sensitive):
    """The reference's walk without random skips; every attempt succeeds."""
    planned = set()
    for acct, p in params.items():
        liked = commented = 0
        done = {(m, t) for a, m, t in history if a == acct}
        for tag in p["hashtags"]:
            medias = sorted((x for x in posts if x["search_tag"] == tag.strip()),
                            key=lambda x: (-x["taken_at"].timestamp(), x["media_id"]))[:10]
            for m in medias:
                mid, cap, tags = m["media_id"], m["caption"].lower(), [h.lower() for h in m["hashtags"]]
                kw = any(t in cap or any(t in h for h in tags) or t in tag.lower() for t in TERMS)
                avoid = any(a.lower() in tags for a in p["avoid_hashtags"])
                can_like = liked < p["likes_per_day"] and (mid, "like") not in done
                if kw or avoid:
                    if can_like:
                        planned.add((acct, "like", mid)); liked += 1; done.add((mid, "like"))  # noqa: E702
                    continue
                if can_like:
                    planned.add((acct, "like", mid)); liked += 1; done.add((mid, "like"))  # noqa: E702
                if commented < p["comments_per_day"] and (mid, "comment") not in done:
                    own = m["author_id"] == viewers[acct]
                    if not (own or (mid in sensitive and not p["allow_sensitive"])):
                        planned.add((acct, "comment", mid)); commented += 1; done.add((mid, "comment"))  # noqa: E702
                if liked >= p["likes_per_day"] and commented >= p["comments_per_day"]:
                    break
    return planned


def test_screening_run_matches_sequential_walk(spark):
    rnd = random.Random(4)
    words = ["sun", "sea", "x", "giveaway", "cat", "dog"]
    posts = []
    for i in range(60):
        tags = rnd.sample(words, 2)
        posts.append({"media_id": f"p{i}", "author_id": rnd.randint(0, 9),
                      "caption": rnd.choice(["hello", "big GIVEAWAY", "nice cat", ""]), "hashtags": tags,
                      "search_tag": f"t{rnd.randint(0, 3)}", "taken_at": datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 500))})
    params = {"A": {"hashtags": ["t0", "t1", "t2"], "avoid_hashtags": ["X"], "likes_per_day": 5,
                    "comments_per_day": 3, "allow_sensitive": False},
              "B": {"hashtags": ["t3", "t1"], "avoid_hashtags": [], "likes_per_day": 2,
                    "comments_per_day": 4, "allow_sensitive": True}}
    viewers = {"A": 1, "B": 2}
    history = [("A", "p3", "like"), ("A", "p5", "comment"), ("B", "p7", "like")]
    sensitive = {"p2", "p9", "p11"}
    pdf = spark.createDataFrame([(p["media_id"], "c", p["author_id"], p["caption"], None, None, p["hashtags"],
                                  p["search_tag"], p["taken_at"]) for p in posts], POSTS)
    prm = spark.createDataFrame([(a, p["hashtags"], p["avoid_hashtags"], p["likes_per_day"], p["comments_per_day"],
                                  p["allow_sensitive"]) for a, p in params.items()],
                                "account string, hashtags array<string>, avoid_hashtags array<string>, "
                                "likes_per_day int, comments_per_day int, allow_sensitive boolean")
    acts = make_actions(spark, [(i, "2024-01-01 00:00:00", t, None, a, m) for i, (a, m, t) in enumerate(history)])
    ver = spark.createDataFrame([(m, "sensitive\nx") for m in sensitive] + [("p0", "safe")], VERDICTS)
    vw = spark.createDataFrame(list(viewers.items()), "account string, viewer_id long")
    got = {(r["account"], r["action_type"], r["media_id"])
           for r in screening_run(prm, pdf, acts, ver, vw).collect()}
    assert got == run_model(params, posts, history, viewers, sensitive)


def test_statistics_view_and_dense_history(spark):
    from postscope.operators.stats import history_pivot
    a = make_actions(spark, [(1, "2024-01-25 10:00:00", "like", "t"), (2, "2024-01-28 10:00:00", "error", None)])
    v = statistics_view(a, "2024-01-31 00:00:00")
    assert set(v) == {"history", "top_tags", "success"}
    assert v["success"].first()["total"] == 2
    dense = [(r["date"], r["like"], r["error"]) for r in history_pivot(a, "2024-01-31 00:00:00", dense=True).collect()]
    assert len(dense) == 8 and dense[0] == ("2024-01-24", 0, 0) and ("2024-01-25", 1, 0) in dense

"""S1-S5, S8 and X1 on real files and awkward values."""

import json

import pytest
from helpers import make_actions

from postscope.operators.classifier import with_classifier
from postscope.sources.actions import append_actions, read_actions, read_actions_iso, v1_projection, with_date
from postscope.sources.jsonfiles import read_run_params, read_shelf_json
from postscope.sources.runlog import read_run_log


@pytest.mark.parametrize("new_first", [False, True])
def test_mixed_schema_log_keeps_links(spark, tmp_path, new_first):
    from pyspark.sql import functions as F
    a = make_actions(spark, [(i, f"2024-01-{1 + i % 9:02d} 00:00:00", "like", "t") for i in range(40)]).withColumn("post_link", F.lit("L"))
    path = str(tmp_path / "log")
    old = lambda: with_date(v1_projection(a.filter("id % 2 = 0"))).write.mode("append").partitionBy("date").parquet(path)
    new = lambda: append_actions(a.filter("id % 2 = 1"), path)
    for write in (new, old) if new_first else (old, new):
        write()
    assert {(r["id"] % 2, r["post_link"]) for r in read_actions(spark, path).collect()} == {(0, None), (1, "L")}


def test_iso_log_and_stamp(spark, tmp_path):
    a = make_actions(spark, [(1, "2024-01-01 10:00:00", "like", "t"), (2, "2024-01-01 10:00:00.5", "like", "t")])
    path = str(tmp_path / "iso")
    a.drop("ts").write.partitionBy("date").parquet(path)
    got = {r["id"]: str(r["ts"]) for r in read_actions_iso(spark, path).collect()}
    assert got == {1: "2024-01-01 10:00:00", 2: "2024-01-01 10:00:00.500000"}
    path = str(tmp_path / "stamped")
    append_actions(a.drop("ts", "timestamp", "date"), path)
    r = read_actions(spark, path).first()
    assert r["ts"] is not None and r["timestamp"][:10] == str(r["ts"])[:10] == str(r["date"])


def test_json_files(spark, tmp_path):
    (tmp_path / "shelf").mkdir()
    (tmp_path / "shelf" / "ann.json").write_text(json.dumps([{"title": "A", "rating": "x"}, {"title": "B", "rating": "99999999999"}, {}], indent=1))
    got = [(r["user_id"], r["position"], r["title"], r["rating"]) for r in read_shelf_json(spark, str(tmp_path / "shelf")).collect()]
    assert sorted(got) == [("ann", 1, "A", None), ("ann", 2, "B", None), ("ann", 3, None, None)]
    (tmp_path / "p").mkdir()
    for name, limit in (("a", "99999999999"), ("b", "abc"), ("c", None), ("d", "7")):
        (tmp_path / "p" / f"{name}.json").write_text(json.dumps({"account": name, "likes_per_day": limit, "password": "x"}, indent=2))
    got = {r["account"]: r["likes_per_day"] for r in read_run_params(spark, str(tmp_path / "p")).collect()}
    assert got == {"a": 2147483647, "b": 50, "c": 50, "d": 7}


def test_settings_files_hold_one_object_or_an_array(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    obj = ['{"account": "a", "likes_per_day": "7", "hashtags": ["x, y", "[z]"]}', '{"account": "b\\"]", "likes_per_day": 9}', '{"account": "c"}']
    (folder / "one.json").write_text(obj[0].replace(', "', ',\n "'))
    (folder / "two.json").write_text(" \n[" + ",\n".join(obj[1:]) + "]\n")
    (folder / "none.json").write_text("[]")
    (folder / "cut.json").write_text('[{"account": "d"}, {"acc')
    got = sorted(((r["account"] or "", r["likes_per_day"], r["hashtags"]) for r in read_run_params(spark, str(folder)).collect()))
    default = read_run_params(spark, str(folder)).filter("account = 'c'").first()["likes_per_day"]
    assert got == [("", default, []), ("a", 7, ["x, y", "[z]"]), ('b"]', 9, []), ("c", default, [])]


def test_run_params_writes_few_files(spark, tmp_path):
    """Files grow with the ids by a thousandth, and every account comes back once."""
    import datetime

    from postscope.catalog import QUERIES
    from postscope.sources import testdata as td
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, u, "click", 1.0, "{}") for i, u in enumerate([*range(2500), *range(50)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    assert td.run_params_files(spark, str(tmp_path)).count() == 3
    got = sorted(int(r["account"]) for r in QUERIES["run_params"](spark, str(tmp_path)).collect())
    assert got == list(range(2500))


def test_classifier_takes_rows_in_small_batches(spark):
    """A plain UDF: Arrow would hold 10,000 whole texts at once."""
    from helpers import plan_text
    df = spark.createDataFrame([("1", "x")], "media_id string, caption string")
    plan = plan_text(with_classifier(df, lambda rec: rec["caption"], ["caption"]))
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan


def test_run_log_keeps_every_line(spark, tmp_path):
    t = "2024-01-05 10:11:12,345 "
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run.log").write_text(
        "no layout\n" + t + "INFO:Commented on post 7: first\nsecond | Link: u\n" + t + "INFO:Liked post 8 (hashtag: None) | Link: v\n"
        + t + "ERROR:Failed to like post 9: boom\nTraceback\n" + t + "INFO:Starting\n")
    got = [(r["record"], r["event"], r["media_id"], r["hashtag"], r["link"], r["detail"]) for r in
           read_run_log(spark, str(tmp_path / "logs")).orderBy("record").collect()]
    assert got == [(1, None, None, None, None, None), (2, "commented", "7", None, "u", "first\nsecond"),
                   (3, "liked", "8", None, "v", None), (4, "like_failed", "9", None, None, "boom\nTraceback"),
                   (5, "other", None, None, None, "Starting")]
    raw = {r["record"]: (r["file"], r["raw"]) for r in read_run_log(spark, str(tmp_path / "logs")).collect()}
    assert raw[1] == ("run.log", "no layout") and raw[2][1].endswith("second | Link: u")


def test_classifier_nulls_and_wrong_results(spark):
    df = spark.createDataFrame([("1", None, 3.0), ("2", "x", None), ("3", "num", 1.0)], "media_id string, caption string, n double")

    def fn(rec):
        if rec["caption"] is None:
            return "none" if rec["n"] == 3.0 else None
        return 5 if rec["caption"] == "num" else ("gap" if rec["n"] is None else None)
    got = {r["media_id"]: (r["result"], r["skipped"], r["error"]) for r in with_classifier(df, fn, ["caption", "n"]).collect()}
    assert got["1"] == ("none", False, None) and got["2"] == ("gap", False, None)
    assert got["3"][0] is None and got["3"][2].startswith("TypeError")


def test_one_log_file_is_read_by_many_tasks(spark, tmp_path):
    """Blocks of 300 bytes: records cut by a block's end, or longer than a block, stay whole and in order."""
    import random

    from postscope.sources.runlog import read_records
    rnd = random.Random(4)
    want = ["junk before the first record"]
    for i in range(400):
        extra = "".join(f"\nline {j} of {i} " + "x" * rnd.randint(0, 60) for j in range(rnd.choice([0, 0, 0, 1, 3, 40 if i % 97 == 0 else 2])))
        want.append(f"2024-01-0{1 + i // 100} 10:{i % 60:02d}:00,{i:03d} INFO:Liked post m{i} (hashtag: None) | Link: https://x/{i}/{extra}")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run.log").write_text("\n".join(want) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = read_records(spark, str(tmp_path / "logs"))
        got = [r["value"] for r in df.orderBy("record").collect()]
        parts = spark.read.option("lineSep", "\n").text(str(tmp_path / "logs")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert parts > 50 and got == want
    assert [r["value"] for r in read_records(spark, str(tmp_path / "logs")).orderBy("record").collect()] == want


def _ids(spark, path):
    return sorted(r["id"] for r in read_actions(spark, path).collect())


def test_a_batch_is_committed_once(spark, tmp_path, monkeypatch):
    import postscope.sources.actions as A
    path = str(tmp_path / "log")
    a = make_actions(spark, [(i, f"2024-01-0{1 + i % 3} 10:00:00", "like", None) for i in range(30)])
    assert append_actions(a.filter("id < 10"), path, "b0") and append_actions(a.filter("id BETWEEN 10 AND 19"), path, "b1")
    assert not append_actions(a.filter("id < 10"), path, "b0")
    assert _ids(spark, path) == list(range(20))
    # cut off after its files were written, before it was committed: not seen, and written anew
    real = A.Folder.write_text

    def killed(self, name, text):
        if name.startswith("_batches/b2"):
            raise KeyboardInterrupt
        real(self, name, text)
    monkeypatch.setattr(A.Folder, "write_text", killed)
    with pytest.raises(KeyboardInterrupt):
        append_actions(a.filter("id >= 20"), path, "b2")
    assert _ids(spark, path) == list(range(20))
    monkeypatch.setattr(A.Folder, "write_text", real)
    assert append_actions(a.filter("id >= 20"), path, "b2")
    assert _ids(spark, path) == list(range(30))
    with pytest.raises(ValueError):
        append_actions(a, path, "a/b")


def test_days_are_joined_without_loss(spark, tmp_path, monkeypatch):
    import postscope.sources.actions as A
    path = str(tmp_path / "log")
    a = make_actions(spark, [(i, f"2024-01-0{1 + i % 3} 10:00:00", "like", None) for i in range(60)])
    for n in range(4):
        append_actions(a.filter(f"id % 4 = {n}"), path, f"b{n}")
    day = tmp_path / "log" / "date=2024-01-02"
    # cut off at every step: readers see each row once
    for step in ("_open/joined", "_joined/joined", "finish"):
        real_write, real_finish = A.Folder.write_text, A._finish_joins
        calls = []

        def write(self, name, text, step=step, real=real_write):
            if name.startswith(step):
                raise KeyboardInterrupt
            real(self, name, text)

        def finish(log, real=real_finish, calls=calls):
            calls.append(1)
            if len(calls) == 2:
                raise KeyboardInterrupt
            real(log)
        monkeypatch.setattr(A.Folder, "write_text", write)
        if step == "finish":
            monkeypatch.setattr(A, "_finish_joins", finish)
        with pytest.raises(KeyboardInterrupt):
            A.compact_day(spark, path, "2024-01-02")
        assert _ids(spark, path) == list(range(60)), step
        monkeypatch.setattr(A.Folder, "write_text", real_write)
        monkeypatch.setattr(A, "_finish_joins", real_finish)
    A.compact_day(spark, path, "2024-01-02")
    assert _ids(spark, path) == list(range(60))
    assert len([d for d in day.iterdir() if d.name.startswith("batch=")]) == 1
    assert A.compact_day(spark, path, "2024-01-03") == 4 and A.compact_day(spark, path, "2024-01-03") == 0
    assert not append_actions(a.filter("id % 4 = 1"), path, "b1") and _ids(spark, path) == list(range(60))


def test_classifier_is_called_once_per_input(spark, tmp_path):
    from postscope.operators.classifier import classify_once
    called = spark.sparkContext.accumulator(0)

    def fn(rec):
        called.add(1)
        if rec["caption"] == "bad":
            raise ValueError("no")
        return None if rec["caption"] is None else f"<{rec['caption']}>"
    rows = [(f"m{i}", c) for i, c in enumerate(["a", "b", "a", None, "bad", "b", "c"])]
    df = spark.createDataFrame(rows, "media_id string, caption string")
    store = str(tmp_path / "store")

    def run(d, version="v1", **kw):
        before = called.value
        got = sorted(tuple(r) for r in classify_once(d, fn, ["caption"], store, version, **kw).collect())
        return got, called.value - before
    first, n = run(df.filter("media_id < 'm3'"))
    assert n == 2 and [r[2] for r in first] == ["<a>", "<b>", "<a>"]
    whole, n = run(df)
    assert n == 3 and [r[2] for r in whole] == ["<a>", "<b>", "<a>", None, None, "<b>", "<c>"]
    assert [r[3] for r in whole] == [False, False, False, True, False, False, False] and whole[4][4] == "ValueError: no"
    assert run(df) == (whole, 0)
    assert run(df, retry_errors=True) == (whole, 1)
    assert run(df, version="v2") == (whole, 5)

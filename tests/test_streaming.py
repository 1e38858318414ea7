from datetime import datetime, timedelta

import pytest
from postscope.operators.quota import quota_over_days, with_history
from postscope.schemas import ACTIONS
from postscope.streaming.actions import DailyCounts, QuotaJob, stored, stream_first_action, stream_quota
from postscope.streaming.store import MergedTable
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def _write_batches(spark, root, batches):
    for i, recs in enumerate(batches):
        data = [(rid, "", ts, "acct", typ, m, None, None, None, None) for rid, ts, typ, m in recs]
        spark.createDataFrame(data, ACTIONS).coalesce(1).write.parquet(f"{root}/in/b{i}")
    return f"{root}/in"


def _stream(spark, src):
    return spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)


B1 = [(1, T0 + timedelta(hours=1), "like", "m1"), (2, T0 + timedelta(days=1, hours=2), "like", "m2")]
B2 = [(3, T0 + timedelta(days=4), "comment", "m3")]
B3 = [(5, T0 + timedelta(days=6), "like", "m5"), (3, T0 + timedelta(days=4), "comment", "m3")]     # 3 comes twice
B4 = [(4, T0 + timedelta(hours=5), "like", "m4"), (6, T0 + timedelta(days=6), "like", "m4")]       # 4 is late


def _counts(job):
    return {(r["date"], r["action_type"]): (r["count"], r["closed"]) for r in job.read().collect()}


def test_daily_counts_late_and_repeated_rows(spark, tmp_path):
    src = _write_batches(spark, tmp_path, [B1, B2, B3, B4])
    job = DailyCounts(spark, str(tmp_path / "out"), delay_days=1).drain(_stream(spark, src), str(tmp_path / "ck"))
    assert _counts(job) == {("2024-01-01", "like"): (1, True), ("2024-01-02", "like"): (1, True),
                            ("2024-01-05", "comment"): (1, True), ("2024-01-07", "like"): (2, False)}
    assert [r["id"] for r in job.late().collect()] == [4]


def test_daily_counts_go_on_after_a_restart(spark, tmp_path):
    """A new job object and query on the same folders: state, watermark and late rows go on."""
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    src = _write_batches(spark, tmp_path, [B1, B2])
    DailyCounts(spark, out, delay_days=1).drain(_stream(spark, src), ck)
    for i, recs in enumerate([B3, B4]):
        data = [(rid, "", ts, "acct", typ, m, None, None, None, None) for rid, ts, typ, m in recs]
        spark.createDataFrame(data, ACTIONS).coalesce(1).write.parquet(f"{src}/c{i}")
    job = DailyCounts(spark, out, delay_days=1).drain(_stream(spark, src), ck)
    assert _counts(job)["2024-01-07", "like"] == (2, False) and _counts(job)["2024-01-05", "comment"] == (1, True)
    assert [r["id"] for r in job.late().collect()] == [4]


def test_the_state_of_daily_counts_is_bounded_by_the_delay(spark, tmp_path):
    batches = [[(10 * d + k, T0 + timedelta(days=d, hours=k), "like", "m") for k in range(5)] for d in range(12)]
    src = _write_batches(spark, tmp_path, batches)
    held = []
    from pyspark.sql.streaming.listener import StreamingQueryListener

    class Held(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryProgress(self, event): held.extend(s.numRowsTotal for s in event.progress.stateOperators)
        def onQueryIdle(self, event): ...
        def onQueryTerminated(self, event): ...
    listener = Held()
    spark.streams.addListener(listener)
    try:
        job = DailyCounts(spark, str(tmp_path / "out"), delay_days=1).drain(_stream(spark, src), str(tmp_path / "ck"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(n for n, _ in _counts(job).values()) == 60
    assert held and max(held) <= 20         # ids of three days, days of three days; not 60


def test_parts_are_folded_into_snapshots(spark, tmp_path):
    fields = spark.createDataFrame([], "k string, n long").schema
    table = MergedTable(spark, str(tmp_path / "t"), fields, lambda rows: rows.groupBy("k").agg(F.max("n").alias("n")), every=3)
    for i in range(11):
        part = spark.createDataFrame([("a", i), (f"k{i}", i)], fields)
        table.put(part, i)
        table.put(part, i)                                  # a replay changes nothing
        base, bases, parts = table._state()
        assert len(parts) < 3 and len(bases) <= 2
    assert {r["k"]: r["n"] for r in table.read().collect()} == {"a": 10, **{f"k{i}": i for i in range(11)}}
    (tmp_path / "t" / "delta-000000000099").mkdir()         # a killed write: no _SUCCESS
    (tmp_path / "t" / "delta-000000000099" / "part-0.parquet").write_bytes(b"half")
    assert table.read().count() == 12


def test_first_action_remembers_for_ever(spark, tmp_path):
    b1 = [(2, T0 + timedelta(minutes=1), "like", "m1"), (3, T0, "like", "m2"), (7, T0, "like", None)]
    b2 = [(4, T0 + timedelta(minutes=5), "like", "m1"), (5, T0 + timedelta(minutes=6), "comment", "m1"), (8, T0, "like", None)]
    b3 = [(6, T0 + timedelta(days=60), "like", "m1"), (1, T0, "like", "m1")]        # long after, and late but earlier
    src = _write_batches(spark, tmp_path, [b1, b2, b3])
    hist = spark.createDataFrame([("acct", "m2", "like"), ("other", "m1", "like")], "account string, media_id string, action_type string")
    out = stream_first_action(_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"), hist)
    assert sorted((r["id"], r["media_id"], r["action_type"]) for r in out.collect()) == [
        (1, "m1", "like"), (5, "m1", "comment"), (7, None, "like"), (8, None, "like")]


def _quota_stream(spark, root, batches):
    schema = "id long, ts timestamp_ntz, account string, date string, media_id string, ok boolean"
    for i, rs in enumerate(batches):
        spark.createDataFrame(rs, schema).coalesce(1).write.parquet(f"{root}/in/b{i}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(f"{root}/in")), schema


def test_quota_stream_equals_batch(spark, tmp_path):
    import random
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        ts = T0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 12))
        rows.append((i, ts, rnd.choice(["a", "b", None]), ts.strftime("%Y-%m-%d"), f"p{rnd.randint(0, 5)}", rnd.random() < 0.7))
    rows.sort(key=lambda r: r[1])
    batches = [rows[:100], rows[100:200], rows[200:]]
    moved = batches[0][::9]                                     # late by one batch
    batches[0] = [r for r in batches[0] if r not in moved]
    batches[1] = batches[1] + moved + batches[0][:5]            # and some twice
    stream, schema = _quota_stream(spark, tmp_path, batches)
    hist = spark.createDataFrame([("a", "p0"), ("b", "p1")], "account string, media_id string")
    got = stream_quota(stream, str(tmp_path / "t"), str(tmp_path / "ck"), 2, ["account", "date"], hist, delay_days=8)
    whole = quota_over_days(with_history(spark.createDataFrame(rows, schema), hist), 2, ["account"], "date").filter("accepted")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in whole.collect())
    assert stored(spark, str(tmp_path / "t" / "too_late"), stream.schema).count() == 0


def test_quota_counts_rows_that_come_too_late(spark, tmp_path):
    day = lambda n: ((T0 + timedelta(days=n)), (T0 + timedelta(days=n)).strftime("%Y-%m-%d"))
    row = lambda i, n: (i, day(n)[0], "a", day(n)[1], f"p{i}", True)
    stream, _ = _quota_stream(spark, tmp_path, [[row(1, 0), row(2, 5)], [row(3, 0), row(4, 6)]])
    got = stream_quota(stream, str(tmp_path / "t"), str(tmp_path / "ck"), 9, ["account", "date"], delay_days=2)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4]
    assert [r["id"] for r in stored(spark, str(tmp_path / "t" / "too_late"), stream.schema).collect()] == [3]


def _day(i, n, post):
    ts = T0 + timedelta(days=n, minutes=i)
    return (i, ts, "a", ts.strftime("%Y-%m-%d"), post, True)


def test_nothing_is_decided_twice_after_finish(spark, tmp_path):
    """Days that ``finish`` decided stay decided in later runs; their posts stay done."""
    stream, schema = _quota_stream(spark, tmp_path, [[_day(1, 0, "p1"), _day(2, 1, "p2")]])
    out, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    got = stream_quota(stream, out, ck, 2, delay_days=5)
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
    more = [_day(3, 1, "p3"), _day(4, 2, "p1"), _day(5, 2, "p4"), _day(6, 20, "p9")]
    spark.createDataFrame(more, schema).coalesce(1).write.parquet(f"{tmp_path}/in/c0")
    got = stream_quota(stream, out, ck, 2, delay_days=5, finish=False)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 5]      # 4: p1 was accepted before; 6: its day is open
    job = QuotaJob(spark, out, stream.schema, 2, delay_days=5)
    assert [r["id"] for r in job.too_late().collect()] == [3]
    assert sorted(r["id"] for r in job.finish().read().collect()) == [1, 2, 5, 6]
    assert sorted(r["id"] for r in job.finish().read().collect()) == [1, 2, 5, 6]


def test_only_a_missing_table_is_empty(spark, tmp_path):
    assert stored(spark, str(tmp_path / "none"), ACTIONS).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"damaged")
    with pytest.raises(Exception):
        stored(spark, str(bad), ACTIONS).count()

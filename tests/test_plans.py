
import re

import pytest

import __spark_entry__ as E
from helpers import plan_text

from postscope.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# Python workers are allowed only for HTML parsing (S6, S7), the injected classifier
# the gram pass of the substring join (J4, J5), joining the lines of log records (S8) and the walk over days
PYTHON_OK = {"shelf_extract", "page_elements", "classifier_hook", "title_match", "title_match_by_reader", "post_features", "post_features_by_profile",
             "screen_by_table", "shelf_crawl", "run_log_parse", "quota"}
STREAMING = {"stream_daily_counts", "stream_late_rows", "stream_first_action", "stream_quota", "append_roundtrip",
             "append_batches", "evolved_scan"}


def _plan(df):
    return plan_text(df)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMING))
def test_plan_shape(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    if key not in PYTHON_OK:
        assert not re.search(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan), key
    # every window is partitioned: the partition spec printed after the window list is never empty
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\], \[", line), (key, line)
    # no cartesian products anywhere
    assert "CartesianProduct" not in plan, key


def test_pushdown_on_driver_tables(spark):
    plan = _plan(E.queries()["lookback"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    plan = _plan(E.queries()["verdict_parse"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plan


def test_top_k_plans(spark):
    for key in ("top_tags", "latest_errors"):
        assert "TakeOrderedAndProject" in _plan(E.queries()[key](spark, SF)), key
    for key in ("recent_per_tag", "quota", "quota_audit", "admit_tags_cap5"):
        assert "WindowGroupLimit" in _plan(E.queries()[key](spark, SF)), key


def test_history_index_is_not_moved(spark):
    """No exchange below the join on the bucketed log's side."""
    from postscope.catalog import q_not_yet_indexed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        plan = _plan(q_not_yet_indexed(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
    log_side = plan[plan.index("SortMergeJoin"):].split("Bucketed: true")
    assert len(log_side) == 2 and plan.count("Exchange hashpartitioning") == 1, plan
    assert "Exchange" not in log_side[0].rsplit("FileScan", 2)[-1].rsplit("Sort [", 1)[-1]


def test_language_agreement_reported(spark):
    """The stop-word scorer is a re-aim of a detection library: report how
    often it agrees with the generator's language label, do not assume it."""
    from pyspark.sql import functions as F

    from postscope.functions.language import detect_language
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = d.select((detect_language("text") == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    print(f"language agreement with documents.lang at sf0.001: {r:.3f}")
    assert r > 0.9


def _final_plan(df):
    """The adaptive plan as it ran (the action finalises the same plan)."""
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


def test_one_pass_per_table(spark):
    q = E.queries()
    # both uses of the per-key / first-success aggregate share one exchange
    for key in ("admit_tags_cap5", "quota"):
        assert "ReusedExchange" in _final_plan(q[key](spark, SF)), key
    # the texts meet the patterns in two scans: one for grams, one to verify
    assert _final_plan(q["title_match"](spark, SF)).count("documents.parquet") <= 2
    # like and comment history come from one scan of the log
    assert _final_plan(q["decisions"](spark, SF)).count("events.parquet") == 1


def test_spread_follows_the_session_option(spark):
    from postscope.plans.ranking import spread
    from postscope.session import SPREAD_OPTION
    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get(SPREAD_OPTION, "")
    try:
        spark.conf.set(SPREAD_OPTION, "0")                # unset / 0: a no-op
        assert "Exchange" not in _plan(spread(d, "doc_id"))
        spark.conf.set(SPREAD_OPTION, "6")                # explicit count, hashed keys
        plan = _plan(spread(d, "doc_id"))
        assert "REPARTITION_BY_NUM" in plan and "xxhash64" in plan
        assert spread(d, "doc_id").rdd.getNumPartitions() == 6
    finally:
        spark.conf.set(SPREAD_OPTION, before)

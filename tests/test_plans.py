"""Physical plans: what is pushed down, what is shuffled, and what stays out of Python."""

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.01"
QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return [e for e in re.findall(r"Exchange (\w+)", text) if e not in ("RoundRobinPartitioning", "HashedRelationBroadcastMode")]


@pytest.mark.parametrize("name", [
    "ext1_page_fields", "ext2_page_record", "ext3_container_rows", "ext4_positional_zip", "ext6_parent_records",
    "ext7_container_records", "ext9_common_ancestor", "ext13_grouped_records", "jon6_descendant_pairs",
    "snk10_record_arrays", "agg10_repeated_containers", "ext5_pages_without_matches", "ext10_link_titles"])
def test_extraction_does_not_shuffle(spark, name):
    text = plan(spark, name)
    assert shuffles(text) == [] and len(re.findall(r"ArrowEvalPython \[", text)) == 1
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name,count", [
    ("agg1_agg2_sliding_window", 1), ("agg5_duration_histogram", 1), ("ddp1_keep_first", 1),
    ("ddp3_distinct_payments", 1), ("win1_sessions", 1), ("win4_immediate_repeats", 1), ("win2_rank_within_type", 1),
    ("win3_guarded_ledger", 1), ("prj2_prj4_transform_tasks", 0), ("snk2_record_messages", 0), ("src9_page_urls", 0), ("agg7_session_actions", 1)])
def test_shuffle_count(spark, name, count):
    assert len(shuffles(plan(spark, name))) == count


def test_no_row_at_a_time_python(spark):
    for name in QUERIES:
        if name.startswith(("agg", "prj", "scl", "set", "win", "jon", "ddp", "srt")) and "stream" not in name:
            assert "BatchEvalPython" not in plan(spark, name), name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "sql1_created_view")
    assert "EqualTo(user_id,8)" in text and "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    assert "GreaterThan(o_orderkey,100)" in plan(spark, "srt3_page_after_key")
    assert "html" not in re.search(r"ReadSchema: (.*)", plan(spark, "scl10_site_key"))[1]
    assert "ReadSchema: struct<ts:timestamp_ntz,props:string>" in plan(spark, "agg1_agg2_sliding_window")


def test_partial_aggregation_before_the_shuffle(spark):
    for name in ("agg1_agg2_sliding_window", "agg4_processed_count", "ddp1_keep_first"):
        text = plan(spark, name)
        assert "partial_" in text, name


@pytest.mark.parametrize("name", ["ddp1_keep_first", "ddp2_first_content", "ddp3_distinct_payments", "jon1_sign_up", "jon9_subscriptions",
                                  "agg6_credit_balances"])
def test_only_hash_aggregates(spark, name):
    text = plan(spark, name)
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert not re.search(r"HashAggregate\([^\n]*(html|text)#", text)


@pytest.mark.parametrize("name", ["src9_page_urls", "src10_topic_names", "src11_pool_seed"])
def test_generators_scan_once(spark, name):
    assert plan(spark, name).count("FileScan") == 1


def test_a_hot_join_key_is_split(spark):
    """A third of the requests ask for one user: adaptive execution splits that partition."""
    from pyspark.sql import functions as F

    from webloom.operators.users import look_up_credits

    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    users = spark.range(50_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("email"),
                                       F.col("id").alias("credits"))
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50_000)
    requests = spark.range(600_000).repartition(8).select(
        "id", F.concat(F.lit("u"), hot.cast("string")).alias("email"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        found = look_up_credits(users, requests)
        rows = found.toArrow()
        assert rows.num_rows == 600_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in changed:
            spark.conf.unset(key)

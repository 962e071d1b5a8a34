"""What physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from footfall.operators import categories, funnel, products
from footfall.operators.adclicks import province_top_ads, ad_stat
from footfall.registry import QUERIES
from footfall.registry import settings as S
from footfall.sources import star

BATCH_QUERIES = sorted(n for n in QUERIES if not n.startswith("stream_"))
FORBIDDEN = ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups", "ExistingRDD")
# The quotas of a sample need the total over one row per hour, and nothing larger.
SINGLE_TASK_WINDOWS = {"session_hour_quota", "session_sample", "session_sample_detail", "session_bucketed_detail"}
GROWTH = ["active_growth_visits", "active_growth_spend", "period_union"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_quadratic_join_no_python_and_no_single_task_window(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]
    lines = plan.splitlines()
    above = [lines[i - 1] + lines[i - 2] for i, line in enumerate(lines) if "SinglePartition" in line]
    windows = [line for line in above if "Window" in line]
    assert not windows or name in SINGLE_TASK_WINDOWS


@pytest.mark.parametrize("name", ["action_scan", "session_histogram", "page_convert_rate", "active_top10_visits"])
def test_time_range_reaches_the_scan(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan


@pytest.mark.parametrize("name", GROWTH)
def test_growth_reads_both_periods_in_one_pruned_scan(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-01" in plan and "LessThan(ts,2024-01-31" in plan
    assert plan.count("ReadSchema: struct<event_id") + plan.count("ReadSchema: struct<ts") == 1


def test_sample_ranks_buckets_not_hours(spark, sf_dir):
    plan = plan_of(QUERIES["session_sample_detail"](spark, sf_dir))
    ranks = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert ranks and all("bucket" in line for line in ranks)


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["click_scan"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_group_limits_work_before_the_shuffle(spark, sf_dir):
    clicks = star.ad_click_log(spark, sf_dir)
    assert plan_of(province_top_ads(ad_stat(clicks))).count("WindowGroupLimit") == 2
    assert plan_of(QUERIES["area_top3_product"](spark, sf_dir)).count("WindowGroupLimit") == 2
    assert plan_of(QUERIES["top10_session_per_category"](spark, sf_dir)).count("WindowGroupLimit") == 2


def test_page_flow_shuffles_views_once(spark, sf_dir):
    actions = star.user_visit_action(spark, sf_dir)
    plan = plan_of(funnel.flow_conversion(actions, S.FLOW))
    assert plan.count("Exchange hashpartitioning(session_id") == 3  # views, slices, and a sample of the views
    assert plan.count("Window") == 2


def test_rankings_need_no_full_sort(spark, sf_dir):
    plan = plan_of(QUERIES["active_top10_visits"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_no_broadcast_of_unknown_size(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        actions = star.user_visit_action(spark, sf_dir)
        keys = actions.select("session_id").distinct()
        assert "Broadcast" not in plan_of(categories.details_of(actions, keys))
        wanted = actions.select(F.col("click_category_id").alias("category_id")).distinct()
        assert "Broadcast" not in plan_of(categories.session_clicks(actions, wanted))
        counts = products.area_product_counts(
            actions.selectExpr("city_id", "click_product_id AS product_id"), star.city_info(spark, sf_dir)
        )
        assert "Broadcast" not in plan_of(products.top_products(counts, star.product_info(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

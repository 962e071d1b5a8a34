"""The registered queries: one callable per operator family, over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import documents, numbers, texts, times
from footfall.operators import (
    activity,
    adclicks,
    categories,
    funnel,
    histogram,
    products,
    sampling,
    scans,
    sessions,
)
from footfall.params import TaskParams
from footfall.registry import settings as S
from footfall.session import configure
from footfall.sinks import render
from footfall.sources import adlog, jsonl, star, tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return function


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    return scans.action_scan(star.user_visit_action(spark, folder), S.START, S.END)


def _rollup(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_rollup(_actions(spark, folder), star.user_info(spark, folder))


def _spans(spark: SparkSession, folder: str, params: TaskParams) -> DataFrame:
    return sessions.matching_spans(_actions(spark, folder), star.user_info(spark, folder), params)


# --- scans and sessions


@query
def action_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _actions(spark, folder)


@query
def click_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scans.click_scan(star.user_visit_action(spark, folder), S.START, S.END)


@query
def session_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup(spark, folder)


@query
def session_filter_age(spark: SparkSession, folder: str) -> DataFrame:
    params = TaskParams(start_age=S.AGES[0], end_age=S.AGES[1])
    return sessions.filter_sessions(_rollup(spark, folder), params)


@query
def session_filter_in_list(spark: SparkSession, folder: str) -> DataFrame:
    params = TaskParams(professionals=S.PROFESSIONALS, cities=S.CITIES)
    return sessions.filter_sessions(_rollup(spark, folder), params)


@query
def session_filter_sex(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.filter_sessions(_rollup(spark, folder), TaskParams(sex=S.SEX))


@query
def session_filter_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.filter_sessions(_rollup(spark, folder), TaskParams(keywords=S.KEYWORDS))


@query
def session_filter_categories(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.filter_sessions(_rollup(spark, folder), TaskParams(category_ids=S.CATEGORIES))


@query
def session_filter_all(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.filter_sessions(_rollup(spark, folder), S.ALL_FILTERS)


@query
def session_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder, S.ALL_FILTERS).select(
        "session_id", "user_id", "start_time", "visit_length", "step_length"
    )


@query
def session_bucket_counts(spark: SparkSession, folder: str) -> DataFrame:
    return histogram.session_counts(_spans(spark, folder, S.RANGE))


@query
def session_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histogram.session_histogram(_spans(spark, folder, S.ALL_FILTERS))


@query
def session_bucket_labels(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _spans(spark, folder, S.RANGE).select(
        numbers.bucket_label(F.col("visit_length"), numbers.DURATION_BUCKETS).alias("length_bucket"),
        numbers.bucket_label(F.col("step_length"), numbers.STEP_BUCKETS).alias("step_bucket"),
    )
    return labelled.groupBy("length_bucket", "step_bucket").agg(F.count(F.lit(1)).alias("session_count"))


@query
def session_hour_quota(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.hour_quotas(_spans(spark, folder, S.RANGE), S.SAMPLE_SIZE)


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    spans = _spans(spark, folder, S.RANGE).select("session_id", "start_time")
    return sampling.session_sample(spans, S.SAMPLE_SIZE, S.SEED)


@query
def session_sample(spark: SparkSession, folder: str) -> DataFrame:
    details = categories.details_of(_actions(spark, folder), _sample(spark, folder))
    return sessions.session_lists(details)


@query
def session_sample_detail(spark: SparkSession, folder: str) -> DataFrame:
    return categories.details_of(_actions(spark, folder), _sample(spark, folder))


# --- categories


def _filtered_actions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.rows_of(_actions(spark, folder), _spans(spark, folder, S.ALL_FILTERS))


@query
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return categories.category_counts(_actions(spark, folder))


@query
def category_counts_left_join(spark: SparkSession, folder: str) -> DataFrame:
    return categories.category_counts_joined(_actions(spark, folder))


@query
def category_touches(spark: SparkSession, folder: str) -> DataFrame:
    return categories.category_touches(_actions(spark, folder))


@query
def filtered_action_count(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered_actions(spark, folder).agg(F.count(F.lit(1)).alias("action_count"))


def _top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return categories.top_categories(categories.category_counts(_filtered_actions(spark, folder)))


@query
def top10_category(spark: SparkSession, folder: str) -> DataFrame:
    return _top_categories(spark, folder)


def _top_sessions(spark: SparkSession, folder: str) -> DataFrame:
    # Few clicks fall on the top categories: counting them first leaves little to match to sessions.
    counts = categories.session_clicks(_actions(spark, folder), _top_categories(spark, folder))
    return categories.top_sessions(sessions.rows_of(counts, _spans(spark, folder, S.ALL_FILTERS)))


@query
def top10_session_per_category(spark: SparkSession, folder: str) -> DataFrame:
    return _top_sessions(spark, folder)


@query
def top10_session_detail(spark: SparkSession, folder: str) -> DataFrame:
    return categories.details_of(_actions(spark, folder), _top_sessions(spark, folder))


# --- page flows


@query
def page_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.pair_counts(funnel.match_flow(funnel.page_pairs(_actions(spark, folder)), S.FLOW))


@query
def page_pairs_all(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.pair_counts(funnel.page_pairs(_actions(spark, folder)))


@query
def start_page_pv(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.start_page_views(_actions(spark, folder), S.FLOW)


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.flow_conversion(_actions(spark, folder), S.FLOW)


@query
def page_convert_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rates(spark, folder)


@query
def page_convert_packed(spark: SparkSession, folder: str) -> DataFrame:
    return render.packed_rates(_rates(spark, folder))


@query
def page_convert_json(spark: SparkSession, folder: str) -> DataFrame:
    return render.json_rates(_rates(spark, folder))


# --- products


def _clicks(spark: SparkSession, folder: str) -> DataFrame:
    return scans.click_scan(star.user_visit_action(spark, folder), S.START, S.END)


@query
def area_click_basic(spark: SparkSession, folder: str) -> DataFrame:
    return products.area_clicks(_clicks(spark, folder), star.city_info(spark, folder))


@query
def area_product_counts(spark: SparkSession, folder: str) -> DataFrame:
    return products.area_product_counts(_clicks(spark, folder), star.city_info(spark, folder))


@query
def area_product_counts_salted(spark: SparkSession, folder: str) -> DataFrame:
    row_key = ("session_id", "action_time")
    clicks = scans.click_scan(star.user_visit_action(spark, folder), S.START, S.END, keep=row_key)
    basic = products.area_clicks(clicks, star.city_info(spark, folder))
    return products.area_product_counts_salted(basic, S.SALT_BUCKETS, row_key)


@query
def area_product_counts_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    row_key = ("session_id", "action_time")
    clicks = scans.click_scan(star.user_visit_action(spark, folder), S.START, S.END, keep=row_key)
    basic = products.area_clicks(clicks, star.city_info(spark, folder))
    return products.area_product_counts_hot_keys(basic, S.SALT_BUCKETS, row_key, S.HOT_SHARE)


@query
def area_product_info(spark: SparkSession, folder: str) -> DataFrame:
    counts = products.area_product_counts(_clicks(spark, folder), star.city_info(spark, folder))
    return products.with_products(counts, star.product_info(spark, folder))


@query
def area_top3_product(spark: SparkSession, folder: str) -> DataFrame:
    counts = products.area_product_counts(_clicks(spark, folder), star.city_info(spark, folder))
    return products.top_products(counts, star.product_info(spark, folder), S.AREA_LEVELS)


# --- user activity


def _log(spark: SparkSession, folder: str, days: activity.Period | None = None) -> DataFrame:
    return star.user_action_log(spark, folder, days)


_PERIOD = (S.START, S.END)
_GROWTH_DAYS = activity.span_of(S.CURRENT_PERIOD, S.PREVIOUS_PERIOD)
_FIRST_DAYS = activity.first_days_span(S.REGISTERED)


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return star.user_base_info(spark, folder)


@query
def purchase_amount_check(spark: SparkSession, folder: str) -> DataFrame:
    """What a ranking by spend leaves out, of a log in which some amounts are far too large, missing or have many digits."""
    money, turn = F.col("purchaseMoney"), F.col("logId") % 7
    odd = F.when(turn == 0, money * 1e30).when(turn == 1, None).when(turn == 2, money / 3).otherwise(money)
    return activity.amount_check(_log(spark, folder, _PERIOD).withColumn("purchaseMoney", odd), _PERIOD)


@query
def active_top10_visits(spark: SparkSession, folder: str) -> DataFrame:
    return activity.top_visits(_log(spark, folder, _PERIOD), _base(spark, folder), _PERIOD)


@query
def active_top10_spend(spark: SparkSession, folder: str) -> DataFrame:
    return activity.top_spend(_log(spark, folder, _PERIOD), _base(spark, folder), _PERIOD)


@query
def active_growth_visits(spark: SparkSession, folder: str) -> DataFrame:
    return activity.visit_growth(
        _log(spark, folder, _GROWTH_DAYS), _base(spark, folder), S.CURRENT_PERIOD, S.PREVIOUS_PERIOD
    )


@query
def active_growth_spend(spark: SparkSession, folder: str) -> DataFrame:
    return activity.spend_growth(
        _log(spark, folder, _GROWTH_DAYS), _base(spark, folder), S.CURRENT_PERIOD, S.PREVIOUS_PERIOD
    )


@query
def period_union(spark: SparkSession, folder: str) -> DataFrame:
    return activity.signed_periods(
        _log(spark, folder, _GROWTH_DAYS), activity.PURCHASE, S.CURRENT_PERIOD, S.PREVIOUS_PERIOD
    )


@query
def first7d_log(spark: SparkSession, folder: str) -> DataFrame:
    log, users = _log(spark, folder, _FIRST_DAYS), _base(spark, folder)
    return activity.first_days_log(log, users, activity.VISIT, S.REGISTERED)


@query
def first7d_visits(spark: SparkSession, folder: str) -> DataFrame:
    return activity.first_days_visits(_log(spark, folder, _FIRST_DAYS), _base(spark, folder), S.REGISTERED)


@query
def first7d_spend(spark: SparkSession, folder: str) -> DataFrame:
    return activity.first_days_spend(_log(spark, folder, _FIRST_DAYS), _base(spark, folder), S.REGISTERED)


# --- ad clicks


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def ad_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _plain_times(adlog.parse_ad_log(star.ad_log_lines(spark, folder)).clicks, "ts")


@query
def ad_log_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return adlog.parse_ad_log(star.ad_log_lines(spark, folder)).quarantine


@query
def ad_user_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.user_daily_counts(star.ad_click_log(spark, folder))


def _blacklist(spark: SparkSession, folder: str, threshold: int = S.BLACKLIST_THRESHOLD) -> DataFrame:
    counts = adclicks.user_daily_counts(star.ad_click_log(spark, folder))
    return adclicks.heavy_clickers(counts, threshold)


@query
def ad_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    return _blacklist(spark, folder)


@query
def ad_blacklist_filter(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.without_blacklisted(star.ad_click_log(spark, folder), _blacklist(spark, folder))


@query
def ad_count_lookup(spark: SparkSession, folder: str) -> DataFrame:
    bought = star.events(spark, folder).where("event_type = 'purchase'")
    keys = bought.selectExpr("CAST(ts AS DATE) AS date", "user_id", "k % 10 AS ad_id")
    return adclicks.counts_of(keys, adclicks.user_daily_counts(star.ad_click_log(spark, folder)))


@query
def ad_stat(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.ad_stat(star.ad_click_log(spark, folder))


@query
def ad_province_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.province_counts(adclicks.ad_stat(star.ad_click_log(spark, folder)))


@query
def ad_province_top3(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.province_top_ads(adclicks.ad_stat(star.ad_click_log(spark, folder)))


@query
def ad_click_trend(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.click_trend(star.ad_click_log(spark, folder))


@query
def ad_sliding_hour(spark: SparkSession, folder: str) -> DataFrame:
    return adclicks.sliding_totals(star.ad_click_log(spark, folder))


# --- records and scalar functions


@query
def action_log_json(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.action_log(star.action_log_lines(spark, folder)).rows


@query
def action_log_json_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.action_log(star.action_log_lines(spark, folder)).quarantine


@query
def user_base_json(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.user_base(star.user_base_lines(spark, folder)).rows


@query
def task_params(spark: SparkSession, folder: str) -> DataFrame:
    parsed = tasks.parse_task_params(star.tasks(spark, folder))
    return parsed.select(
        "task_id",
        "task_name",
        "start_date",
        "end_date",
        "start_age",
        "end_age",
        F.array_join("keywords", ",").alias("keywords"),
        F.array_join(F.col("target_page_flow").cast("array<string>"), ",").alias("target_page_flow"),
        "sex",
        F.array_join("professionals", ",").alias("professionals"),
        F.array_join("cities", ",").alias("cities"),
        F.array_join(F.col("category_ids").cast("array<string>"), ",").alias("category_ids"),
        "cycle",
    )


@query
def scalar_dates(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    text = F.date_format("ts", "yyyy-MM-dd H:mm:ss")
    parsed = times.parse_time_ntz(F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(text))
    starts = {
        f"{cycle}_{name}": times.cycle_start(ts, cycle, step).cast("date")
        for cycle in times.CYCLES
        for name, step in (("start", 0), ("before", -1))
    }
    return star.events(spark, folder).select(
        "event_id",
        parsed.alias("parsed"),
        times.format_time(ts).alias("time_text"),
        times.format_date(ts).alias("date_text"),
        times.date_key(ts).alias("date_key"),
        times.minute_key(ts).alias("minute_key"),
        times.parse_date_key(times.date_key(ts)).alias("key_date"),
        times.date_hour(ts).alias("date_hour"),
        times.yesterday(ts).alias("yesterday"),
        times.seconds_between(parsed, F.to_date("ts").cast("timestamp_ntz")).alias("second_of_day"),
        times.is_before(parsed, F.lit("2024-01-15").cast("timestamp_ntz")).alias("is_before"),
        times.is_after(parsed, F.lit("2024-01-15").cast("timestamp_ntz")).alias("is_after"),
        F.date_add(F.to_date("ts"), 7).alias("week_later"),
        *[column.alias(name) for name, column in starts.items()],
    )


@query
def scalar_strings(spark: SparkSession, folder: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    padded = F.concat(F.lit(","), F.col("p_type"), F.lit(",,"))
    id_list = F.concat_ws(",", size.cast("string"), F.when(size % 3 == 0, "8"), name, F.lit("7"), F.lit(""))
    return star.part(spark, folder).select(
        "p_partkey",
        texts.is_empty(F.when(size % 5 != 0, name)).alias("is_empty"),
        texts.trim_comma(padded).alias("trimmed"),
        texts.two_digits(size.cast("string")).alias("two_digits"),
        texts.concat_long_string(F.col("p_partkey"), name, ":").alias("id_and_name"),
        F.size(texts.split_ids(id_list)).alias("id_count"),
        numbers.ratio(size, F.col("p_partkey") % 7).alias("ratio"),
        (-size).alias("negated"),
    )


@query
def scalar_json(spark: SparkSession, folder: str) -> DataFrame:
    info = F.col("info")
    damaged = F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), info)).otherwise(info)
    return star.product_info(spark, folder).select(
        "id",
        documents.json_field(info, "product_status").alias("status_text"),
        documents.json_field(info, "nothing").alias("missing"),
        documents.json_field(damaged, "product_status").alias("broken"),
        products.product_status(info).alias("product_status"),
    )


@query
def packed_field_get_set(spark: SparkSession, folder: str) -> DataFrame:
    packed = F.concat(
        F.lit("session_id=s"),
        F.col("user_id").cast("string"),
        F.lit("|search_keywords="),
        F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(""),
        F.lit("|step_length="),
        F.col("k").cast("string"),
    )
    return star.events(spark, folder).select(
        "event_id",
        texts.get_field(packed, "session_id").alias("session_id"),
        texts.get_field(packed, "search_keywords").alias("search_keywords"),
        texts.get_field(packed, "step_length").try_cast("bigint").alias("step_length"),
        texts.get_field(packed, "age").alias("age"),
        texts.set_field(packed, "step_length", (F.col("k") + 1).cast("string")).alias("changed"),
        texts.set_field(packed, "age", F.lit("30")).alias("unchanged"),
    )

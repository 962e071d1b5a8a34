"""The behaviour tables, derived from a star schema with an ``events`` table.

Every function returns one of the logical input tables as a lazy projection, so filters and column
choices of an analysis still reach the Parquet scan below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.functions.times import within

_EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
_CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
_NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"
_REGION = "r_regionkey INT, r_name STRING"
_PART = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


_DAY = "CAST(ts AS DATE)"
_SECOND = "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)"
_IS_PURCHASE = "event_type = 'purchase'"


def _read(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{table}.parquet")


def _with_k(frame: DataFrame) -> DataFrame:
    return frame.selectExpr("*", "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return _with_k(_read(spark, folder, "events", _EVENTS))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of its files.

    The braces make the path a pattern, which a stream takes for a single file and a folder alike.
    """
    return _with_k(spark.readStream.schema(_EVENTS).parquet(f"{folder}/{{events.parquet}}"))


def user_visit_action(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).selectExpr(
        f"{_DAY} AS date",
        "user_id",
        f"concat('s_', CAST(user_id AS STRING), '_', CAST({_DAY} AS STRING)) AS session_id",
        "k % 10 AS page_id",
        f"{_SECOND} AS action_time",
        "CASE WHEN event_type = 'view' THEN concat('kw', CAST(k % 12 AS STRING)) END AS search_keyword",
        "CASE WHEN event_type = 'click' THEN k END AS click_category_id",
        "CASE WHEN event_type = 'click' THEN event_id % 200 END AS click_product_id",
        "CASE WHEN event_type = 'signup' THEN concat(CAST(k AS STRING), ',', CAST((k + 1) % 100 AS STRING)) END"
        " AS order_category_ids",
        "CASE WHEN event_type = 'signup' THEN CAST(event_id % 200 AS STRING) END AS order_product_ids",
        f"CASE WHEN {_IS_PURCHASE} THEN CAST(k AS STRING) END AS pay_category_ids",
        f"CASE WHEN {_IS_PURCHASE} THEN CAST(event_id % 200 AS STRING) END AS pay_product_ids",
        "user_id % 25 AS city_id",
    )


def user_info(spark: SparkSession, folder: str) -> DataFrame:
    customer = _read(spark, folder, "customer", _CUSTOMER)
    nation = _read(spark, folder, "nation", _NATION)
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
        "c_custkey AS user_id",
        "c_name AS username",
        "c_name AS name",
        "CAST(18 + c_custkey % 50 AS INT) AS age",
        "c_mktsegment AS professional",
        "n_name AS city",
        "CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex",
    )


def city_info(spark: SparkSession, folder: str) -> DataFrame:
    nation = _read(spark, folder, "nation", _NATION)
    region = _read(spark, folder, "region", _REGION)
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "CAST(n_nationkey AS BIGINT) AS city_id", "n_name AS city_name", "r_name AS area"
    )


def part(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part", _PART)


def product_info(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder).selectExpr(
        "p_partkey AS id",
        "p_name AS product_name",
        """concat('{"product_status":', CAST(p_size % 2 AS STRING), '}') AS info""",
    )


def user_base_info(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "customer", _CUSTOMER).selectExpr(
        "c_custkey AS userId",
        "c_name AS username",
        "CAST(date_add(DATE '2024-01-01', CAST(c_custkey % 20 AS INT)) AS TIMESTAMP_NTZ) + INTERVAL '6' HOUR"
        " AS registTime",
    )


def user_action_log(
    spark: SparkSession, folder: str, days: tuple[str, str] | None = None
) -> DataFrame:
    """The log, or its part between two days.

    ``actionTime`` drops fractions of a second, so a condition on it does not reach the scan. The
    same days as a condition on ``ts`` do, and mean the same.
    """
    source = events(spark, folder)
    if days is not None:
        source = source.where(within(source, "ts", *days))
    return source.selectExpr(
        "event_id AS logId",
        "user_id AS userId",
        f"{_SECOND} AS actionTime",
        f"CASE WHEN {_IS_PURCHASE} THEN 1 ELSE 0 END AS actionType",
        f"CASE WHEN {_IS_PURCHASE} THEN value ELSE 0.0D END AS purchaseMoney",
    )


def ad_click_log(spark: SparkSession, folder: str) -> DataFrame:
    return ad_clicks_of(events(spark, folder), city_info(spark, folder))


def ad_clicks_of(event_frame: DataFrame, cities: DataFrame) -> DataFrame:
    """Ad clicks of a static or streaming event frame."""
    clicks = event_frame.where("event_type IN ('click', 'view')")
    return clicks.join(cities, clicks.user_id % 25 == cities.city_id).selectExpr(
        "ts", "area AS province", "city_name AS city", "user_id", "k % 10 AS ad_id"
    )


def ad_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same clicks as log lines; the events of type ``error`` become lines damaged in five ways."""
    return ad_log_lines_of(events(spark, folder))


def ad_log_lines_of(event_frame: DataFrame) -> DataFrame:
    """Log lines of a static or streaming event frame."""
    head = (
        "CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING), concat('province', CAST(user_id % 5 AS STRING)),"
        " concat('city', CAST(user_id % 25 AS STRING))"
    )
    user, ad = "CAST(user_id AS STRING)", "CAST(k % 10 AS STRING)"
    return (
        event_frame.where("event_type IN ('click', 'view', 'error')")
        .selectExpr(
            f"CASE WHEN event_type <> 'error' THEN concat_ws(' ', {head}, {user}, {ad})"
            f" WHEN event_id % 5 = 0 THEN concat_ws(' ', {head}, {user})"
            f" WHEN event_id % 5 = 1 THEN concat_ws(' ', {head}, concat('u', {user}), {ad})"
            f" WHEN event_id % 5 = 2 THEN concat_ws(' ', '99999999999999999', 'province1', 'city1', {user}, {ad})"
            f" WHEN event_id % 5 = 3 THEN concat_ws(' ', {head}, {user}, {ad}, '1')"
            " ELSE '' END AS value"
        )
    )


def action_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The action log as JSON lines; the events of type ``error`` become lines damaged in four ways.

    By ``event_id`` modulo four: an id with a leading zero, which is no JSON; a time that can't be
    read; a blank line; no line at all.
    """
    return events(spark, folder).selectExpr(
        """CASE WHEN event_type = 'error' AND event_id % 4 = 2 THEN '  '
                WHEN event_type <> 'error' OR event_id % 4 <> 3 THEN
           concat('{"logId": ', CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN '0' ELSE '' END,
                  CAST(event_id AS STRING), ',"userId": ', CAST(user_id AS STRING), ', "actionTime": "',
                  CASE WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'bad'
                       ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END,
                  '", "actionType": ', CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END,
                  ', "purchaseMoney": ',
                  CASE WHEN event_type = 'purchase' THEN CAST(value AS STRING) ELSE '0.0' END, '}') END AS value"""
    )


def user_base_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Users as JSON lines; every seventh one has a registration time that can't be read."""
    return user_base_info(spark, folder).selectExpr(
        """concat('{"userId": ', CAST(userId AS STRING), ', "username": "', username, '", "registTime": "',
                  CASE WHEN userId % 7 = 0 THEN 'unknown' ELSE date_format(registTime, 'yyyy-MM-dd H:mm:ss') END,
                  '"}') AS value"""
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """A task record per customer, with parameters that depend on the customer."""
    return _read(spark, folder, "customer", _CUSTOMER).selectExpr(
        "c_custkey AS task_id",
        "concat('task ', c_name) AS task_name",
        """concat('{"startDate":"', CAST(date_add(DATE '2024-01-01', CAST(c_custkey % 20 AS INT)) AS STRING),
                  ' 10:00:00","endDate":"2024-01-30 10:00:00","startAge":', CAST(20 + c_custkey % 10 AS STRING),
                  ',"endAge":"', CAST(50 + c_custkey % 10 AS STRING),
                  '","professionals":"p', CAST(c_custkey % 3 AS STRING), ',p9","cities":"c',
                  CAST(c_custkey % 4 AS STRING), '","categoryIds":"', CAST(c_custkey % 10 AS STRING), ',x,50"',
                  CASE c_custkey % 3 WHEN 0 THEN ',"sex":"male"' WHEN 1 THEN ',"sex":"female"' ELSE '' END,
                  ',"cycle":"', CASE c_custkey % 2 WHEN 0 THEN 'week' ELSE 'month' END,
                  '","keywords":"kw', CAST(c_custkey % 12 AS STRING), ',kw1","targetPageFlow":"1,2,',
                  CAST(c_custkey % 7 AS STRING), '"}')
           AS task_param""",
    )

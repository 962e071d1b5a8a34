"""Registered queries that run a live pipeline over the whole event table and read its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.registry import settings as S
from footfall.registry.queries import query
from footfall.session import local_fallback, shared_folder
from footfall.sources import star
from footfall.streaming import pipelines
from footfall.streaming.tables import AdTables


def _tables(spark: SparkSession) -> AdTables:
    return AdTables(shared_folder(spark, "ad-clicks", fallback=local_fallback(spark)))


def _clicks(spark: SparkSession, folder: str) -> DataFrame:
    stream = star.event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return star.ad_clicks_of(stream, star.city_info(spark, folder))


def _cleaned(spark: SparkSession, folder: str) -> AdTables:
    tables = _tables(spark)
    clicks = _clicks(spark, folder)
    pipelines.drain(pipelines.clean_click_stream(clicks, tables, threshold=S.BLACKLIST_THRESHOLD))
    return tables


@query
def stream_user_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder).user_counts.totals(spark)


@query
def stream_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder).blacklist.all(spark)


@query
def stream_ad_stat(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark)
    pipelines.drain(pipelines.stat_stream(_clicks(spark, folder), tables))
    return tables.stat.totals(spark)


@query
def stream_province_top3(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark)
    pipelines.drain(pipelines.stat_stream(_clicks(spark, folder), tables))
    return tables.province_top3(spark)


@query
def stream_click_trend(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark)
    pipelines.drain(pipelines.trend_stream(_clicks(spark, folder), tables))
    return tables.trend.totals(spark)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def stream_sliding_hour(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark)
    pipelines.drain(pipelines.sliding_stream(_clicks(spark, folder), tables))
    return _plain(tables.sliding_totals(spark), "window_start", "window_end")


@query
def stream_log_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks out of raw log lines, some of them damaged."""
    return _plain(_from_lines(spark, folder).log_clicks.all(spark), "ts")


@query
def stream_log_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return _from_lines(spark, folder).log_quarantine.all(spark)


def _from_lines(spark: SparkSession, folder: str) -> AdTables:
    tables = _tables(spark)
    lines = star.ad_log_lines_of(star.event_stream(spark, folder))
    pipelines.drain(pipelines.log_line_stream(lines, tables))
    return tables


@query
def stream_closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hours emitted as closed, and clicks that came too late for theirs, over micro-batches of whole days in a mixed order."""
    tables = AdTables(shared_folder(spark, "ad-windows", local_fallback(spark)), fold_every=3)
    clicks = star.ad_click_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    for batch_id in range(S.WINDOW_BATCHES):
        # The days of a slice, and every tenth click of its ad a slice too late.
        due = F.floor(F.datediff(F.to_date("ts"), F.lit(S.FIRST_DAY)) / S.REPLAY_DAYS) + F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)
        batch = clicks.where(F.least(due, F.lit(S.WINDOW_BATCHES - 1)) == batch_id)
        pipelines.closed_window_batch(spark, batch, batch_id, tables, "60 minutes", "30 minutes")
    closed = tables.closed_windows.rows(spark).select("window_start", "ad_id", "click_count", F.lit("closed").alias("kind"))
    late = tables.late_clicks.rows(spark).groupBy(F.window("ts", "60 minutes")["start"].alias("window_start"), "ad_id")
    late = late.agg(F.count(F.lit(1)).alias("click_count")).withColumn("kind", F.lit("late"))
    return _plain(closed.unionByName(late), "window_start")


@query
def stream_snapshot_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics as they were after the third micro-batch, read when later ones are long there."""
    return _replayed(spark, folder).stat.totals(spark, upto=2)


def _replayed(spark: SparkSession, folder: str) -> AdTables:
    """History in several micro-batches, so that a batch meets the list that earlier ones have made."""
    tables = AdTables(shared_folder(spark, "ad-replay", local_fallback(spark)), keep_clicks=True, fold_every=3)
    clicks = star.ad_click_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    pipelines.replay(clicks, tables, days=S.REPLAY_DAYS, threshold=S.BLACKLIST_THRESHOLD)
    return tables


@query
def stream_clean_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_replayed(spark, folder).clicks.all(spark), "ts")


@query
def stream_blacklist_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """User counts of the replayed history: clicks of listed users are in no later batch's counts."""
    return _replayed(spark, folder).user_counts.totals(spark)

"""Ad clicks. Each function takes a static frame, and a streaming frame where it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

USER_COUNT_KEYS = ("date", "user_id", "ad_id")
STAT_KEYS = ("date", "province", "city", "ad_id")
TREND_KEYS = ("date", "hour", "minute", "ad_id")
PANE_KEYS = ("date", "pane_start", "ad_id")
BLACKLIST_THRESHOLD = 100


def _day() -> Column:
    return F.to_date("ts").alias("date")


def _clicks() -> Column:
    return F.count(F.lit(1)).alias("click_count")


def without_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users who are not on the list. Static or streaming."""
    return clicks.join(blacklist.select("user_id"), "user_id", "left_anti").select(*clicks.columns)


def user_daily_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per day, user and ad."""
    return clicks.groupBy(_day(), "user_id", "ad_id").agg(_clicks())


def heavy_clickers(counts: DataFrame, threshold: int = BLACKLIST_THRESHOLD) -> DataFrame:
    """Users who reached the threshold on any day with any ad."""
    return counts.where(F.col("click_count") >= threshold).select("user_id").distinct()


def new_on_blacklist(users: DataFrame, blacklist: DataFrame) -> DataFrame:
    return users.join(blacklist, "user_id", "left_anti")


def counts_of(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """The stored counts of some (day, user, ad) keys, looked up in one join."""
    return counts.join(keys.select(*USER_COUNT_KEYS).distinct(), list(USER_COUNT_KEYS), "left_semi")


def ad_stat(clicks: DataFrame) -> DataFrame:
    """Clicks per day, province, city and ad."""
    return clicks.groupBy(_day(), "province", "city", "ad_id").agg(_clicks())


def province_counts(stat: DataFrame) -> DataFrame:
    """City counts added up to provinces."""
    return stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top_ads(stat: DataFrame, top: int = 3) -> DataFrame:
    """The most clicked ads of each day and province."""
    best = Window.partitionBy("date", "province").orderBy(F.desc("click_count"), F.asc("ad_id"))
    ranked = province_counts(stat).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("date", "province", "ad_id", "click_count")


def _minute_columns(minute: Column) -> list[Column]:
    return [
        F.to_date(minute).alias("date"),
        F.date_format(minute, "HH").alias("hour"),
        F.date_format(minute, "mm").alias("minute"),
    ]


def click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks per minute and ad."""
    per_minute = clicks.groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").agg(_clicks())
    return per_minute.select(*_minute_columns(F.col("w.start")), "ad_id", "click_count")


def sliding_totals(clicks: DataFrame, length: str = "60 minutes", slide: str = "10 minutes") -> DataFrame:
    """Clicks per ad in every window of ``length`` that starts each ``slide``.

    Clicks are first counted in panes as long as the slide. Only panes, not clicks, are copied into
    the windows that overlap them. ``length`` must be a multiple of ``slide``.
    """
    return windows_of(pane_counts(clicks, slide), length, slide)


def pane_counts(clicks: DataFrame, slide: str = "10 minutes") -> DataFrame:
    """Clicks per ad in stretches as long as the slide."""
    panes = clicks.groupBy(F.window("ts", slide).alias("pane"), "ad_id").agg(_clicks())
    return panes.select(
        F.to_date("pane.start").alias("date"), F.col("pane.start").alias("pane_start"), "ad_id", "click_count"
    )


def windows_of(panes: DataFrame, length: str = "60 minutes", slide: str = "10 minutes") -> DataFrame:
    """Panes added up to the windows that overlap them."""
    windows = panes.groupBy(F.window("pane_start", length, slide).alias("w"), "ad_id")
    return windows.agg(F.sum("click_count").alias("click_count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ad_id", "click_count"
    )

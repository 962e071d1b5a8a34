"""The live pipelines. Each starts one streaming query and returns it.

All of them keep their progress in a checkpoint and write by micro-batch id, so a restarted query
that repeats its last micro-batch leaves the tables as they were.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from footfall.operators import adclicks
from footfall.sinks.changelog import ChangeLog, days_in
from footfall.sinks.tables import replace_groups
from footfall.sources.adlog import parse_ad_log
from footfall.streaming.tables import AdTables


def _start(writer: DataStreamWriter, tables: AdTables, name: str, every: str | None) -> StreamingQuery:
    """Run every so often, or once over everything that is there now."""
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.queryName(f"{name} in {tables.base}").option("checkpointLocation", tables.checkpoint(name)).start()


def refresh_province_top3(tables: AdTables, stat_of_days: DataFrame) -> None:
    """Rank the ads of some whole days anew and replace the ranking of exactly those days."""
    replace_groups(adclicks.province_top_ads(stat_of_days), tables.province_top3_path, ["date"])


def clean_click_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    tables: AdTables,
    threshold: int = adclicks.BLACKLIST_THRESHOLD,
) -> None:
    """Take one micro-batch, live or replayed from history, into all tables of the clean clicks.

    The order makes the blacklist dynamic: drop the clicks of listed users, add the rest to the
    counts, list the users who have reached the threshold. The next micro-batch reads the longer
    list. A repeated micro-batch reads the list as it was before that batch.
    """
    logs = [tables.blacklist, tables.user_counts, tables.stat]
    for log in [*logs, tables.clicks] if tables.keep_clicks else logs:
        log.fold(spark, batch_id)
    known = tables.blacklist.before(spark, batch_id)
    tables.clicks.write_batch(adclicks.without_blacklisted(batch, known), batch_id)
    # From here on the stored clicks are read, not the source again.
    kept = tables.clicks.of_batch(spark, batch_id)
    tables.user_counts.write_batch(adclicks.user_daily_counts(kept), batch_id)
    tables.stat.write_batch(adclicks.ad_stat(kept), batch_id)
    days = days_in(tables.stat.of_batch(spark, batch_id))

    touched = tables.user_counts.of_batch(spark, batch_id)
    counts = adclicks.counts_of(touched, tables.user_counts.totals(spark, days, upto=batch_id))
    heavy = adclicks.heavy_clickers(counts, threshold)
    tables.blacklist.write_batch(adclicks.new_on_blacklist(heavy, known), batch_id)
    refresh_province_top3(tables, tables.stat.totals(spark, days, upto=batch_id))
    if not tables.keep_clicks:
        tables.clicks.forget_before(spark, batch_id)


def clean_click_stream(
    clicks: DataFrame,
    tables: AdTables,
    *,
    threshold: int = adclicks.BLACKLIST_THRESHOLD,
    every: str | None = None,
) -> StreamingQuery:
    """Blacklist, user counts, statistics and province ranking, from one query."""
    spark = clicks.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        # The batch belongs to a session of its own, which the joins with stored tables must share.
        clean_click_batch(batch.sparkSession, batch, batch_id, tables, threshold)

    writer = clicks.writeStream.outputMode("append").foreachBatch(process)
    return _start(writer, tables, "clean_clicks", every)


def replay(
    clicks: DataFrame, tables: AdTables, *, days: int = 1, threshold: int = adclicks.BLACKLIST_THRESHOLD
) -> None:
    """Run history through the same tables in micro-batches of so many days, oldest first.

    A stretch of days without clicks is a micro-batch too.
    """
    spark = clicks.sparkSession
    span = clicks.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).head()
    if span[0] is None:
        return
    for batch_id in range((span[1] - span[0]).days // days + 1):
        start = span[0] + dt.timedelta(days=batch_id * days)
        first, end = (F.lit(d).cast("timestamp") for d in (start, start + dt.timedelta(days=days)))
        batch = clicks.where((F.col("ts") >= first) & (F.col("ts") < end))
        clean_click_batch(spark, batch, batch_id, tables, threshold)


def _increments(clicks: DataFrame, log: ChangeLog, count, tables: AdTables, name: str, every: str | None, after=None):
    """Add what each micro-batch counts to a log. No state, no watermark: however late, every click counts."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log.fold(spark, batch_id)
        log.write_batch(count(batch), batch_id)
        if after is not None:
            after(spark, batch_id)

    return _start(clicks.writeStream.outputMode("append").foreachBatch(process), tables, name, every)


def stat_stream(clicks: DataFrame, tables: AdTables, *, every: str | None = None) -> StreamingQuery:
    """Cumulative statistics with the province ranking kept up to date, for clicks that need no blacklist."""

    def rank(spark: SparkSession, batch_id: int) -> None:
        days = days_in(tables.stat.of_batch(spark, batch_id))
        refresh_province_top3(tables, tables.stat.totals(spark, days, upto=batch_id))

    return _increments(clicks, tables.stat, adclicks.ad_stat, tables, "ad_stat", every, rank)


def trend_stream(clicks: DataFrame, tables: AdTables, *, every: str | None = None) -> StreamingQuery:
    """Clicks per minute and ad over the unfiltered stream."""
    return _increments(clicks, tables.trend, adclicks.click_trend, tables, "ad_click_trend", every)


def sliding_stream(
    clicks: DataFrame, tables: AdTables, *, slide: str = "10 minutes", every: str | None = None
) -> StreamingQuery:
    """Panes of the sliding windows, which are added up when read."""

    def panes(batch: DataFrame) -> DataFrame:
        return adclicks.pane_counts(batch, slide)

    return _increments(clicks, tables.panes, panes, tables, "ad_click_panes", every)


def log_line_batch(spark: SparkSession, batch: DataFrame, batch_id: int, tables: AdTables) -> None:
    """Take one micro-batch of raw log lines into clicks and quarantine, and what the clicks count into statistics.

    All tables write by batch id, so a micro-batch that is repeated after any of them was written changes nothing. A damaged
    line is kept as it came; it ends no batch.
    """
    logs = [tables.log_clicks, tables.log_quarantine, tables.stat]
    for log in logs:
        log.fold(spark, batch_id)
    parsed = parse_ad_log(batch)
    tables.log_quarantine.write_batch(parsed.quarantine, batch_id)
    tables.log_clicks.write_batch(parsed.clicks, batch_id)
    tables.stat.write_batch(adclicks.ad_stat(tables.log_clicks.of_batch(spark, batch_id)), batch_id)


def log_line_stream(lines: DataFrame, tables: AdTables, *, every: str | None = None) -> StreamingQuery:
    """Raw log lines, in a column ``value``, fanned out to several tables."""

    def process(batch: DataFrame, batch_id: int) -> None:
        log_line_batch(batch.sparkSession, batch, batch_id, tables)

    return _start(lines.writeStream.outputMode("append").foreachBatch(process), tables, "log_lines", every)


def closed_window_batch(
    spark: SparkSession, batch: DataFrame, batch_id: int, tables: AdTables, length: str, lateness: str
) -> None:
    """Count one micro-batch in windows of ``length``; emit the windows that it closes.

    The watermark is the newest time of all batches before, less ``lateness``; what is at or below it when the batch begins
    is closed. Clicks of closed windows go to a table of their own, whole. All others are counted, and the windows between the
    watermark before and after the batch are emitted with their final counts, once each. Counts by window, newest times
    and both results are versioned tables, so a repeated batch starts from what was there before it.
    """
    logs = [tables.window_counts, tables.closed_windows, tables.late_clicks, tables.watermarks]
    for log in logs:
        log.fold(spark, batch_id)
    before = tables.watermarks.before(spark, batch_id).head()[0]
    newest = batch.agg(F.max("ts").alias("newest")).where("newest IS NOT NULL")
    tables.watermarks.write_batch(newest, batch_id)
    after = tables.watermarks.before(spark, batch_id + 1).head()[0]

    def closed(by: dt.datetime | None) -> Column:
        end = F.col("window_start") + F.expr(f"INTERVAL {length}")
        return F.lit(False) if by is None else end <= F.lit(by).cast("timestamp") - F.expr(f"INTERVAL {lateness}")

    dealt = batch.withColumn("window_start", F.window("ts", length)["start"])
    late = F.coalesce(closed(before), F.lit(False))
    tables.late_clicks.write_batch(dealt.where(late), batch_id)
    counted = dealt.where(~late).groupBy(F.to_date("window_start").alias("date"), "window_start", "ad_id")
    tables.window_counts.write_batch(counted.agg(F.count(F.lit(1)).alias("click_count")), batch_id)
    ready = tables.window_counts.totals(spark, upto=batch_id).where(closed(after) & ~late)
    tables.closed_windows.write_batch(ready, batch_id)


def closed_window_stream(
    clicks: DataFrame,
    tables: AdTables,
    *,
    length: str = "60 minutes",
    lateness: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    """Clicks per window and ad, each window emitted once, when no more clicks are waited for."""

    def process(batch: DataFrame, batch_id: int) -> None:
        closed_window_batch(batch.sparkSession, batch, batch_id, tables, length, lateness)

    return _start(clicks.writeStream.outputMode("append").foreachBatch(process), tables, "closed_windows", every)


def drain(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for a query that ends by itself; stop it if it takes longer than ``timeout`` seconds."""
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
        raise TimeoutError(f"{query.name} did not end within {timeout} seconds")

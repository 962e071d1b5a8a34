"""The result tables of the live pipelines, below one base folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.adclicks import PANE_KEYS, STAT_KEYS, TREND_KEYS, USER_COUNT_KEYS, windows_of
from footfall.sinks.changelog import FOLD_EVERY, BatchLog, ChangeLog, read_or_empty

_CLICK = "ts TIMESTAMP, province STRING, city STRING, user_id BIGINT, ad_id BIGINT"


def _newest(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("newest").alias("newest"))


class AdTables:
    """``keep_clicks`` keeps the clicks that passed the blacklist; otherwise only the newest batches hold any."""

    def __init__(self, base: str, *, keep_clicks: bool = False, fold_every: int = FOLD_EVERY) -> None:
        self.base = base
        self.keep_clicks = keep_clicks

        def at(name: str) -> str:
            return os.path.join(base, name)

        self.blacklist = BatchLog(at("ad_blacklist"), "user_id BIGINT", DataFrame.distinct, fold_every=fold_every)
        # Clicks never become fewer by folding; where they are kept, it is few folders that are wanted.
        forgotten = {} if keep_clicks else {"keep": 2}
        self.clicks = BatchLog(at("ad_clicks_kept"), _CLICK, lambda rows: rows, fold_every=fold_every, **forgotten)
        self.user_counts = ChangeLog(
            at("ad_user_click_count"),
            USER_COUNT_KEYS,
            "click_count",
            "date DATE, user_id BIGINT, ad_id BIGINT, click_count BIGINT",
            fold_every=fold_every,
        )
        self.stat = ChangeLog(
            at("ad_stat"),
            STAT_KEYS,
            "click_count",
            "date DATE, province STRING, city STRING, ad_id BIGINT, click_count BIGINT",
            fold_every=fold_every,
        )
        self.trend = ChangeLog(
            at("ad_click_trend"),
            TREND_KEYS,
            "click_count",
            "date DATE, hour STRING, minute STRING, ad_id BIGINT, click_count BIGINT",
            fold_every=fold_every,
        )
        self.panes = ChangeLog(
            at("ad_click_panes"),
            PANE_KEYS,
            "click_count",
            "date DATE, pane_start TIMESTAMP, ad_id BIGINT, click_count BIGINT",
            fold_every=fold_every,
        )
        self.log_clicks = BatchLog(at("ad_log_clicks"), _CLICK, lambda rows: rows, fold_every=fold_every)
        self.log_quarantine = BatchLog(at("ad_log_quarantine"), "line STRING", lambda rows: rows, fold_every=fold_every)
        window = "date DATE, window_start TIMESTAMP, ad_id BIGINT, click_count BIGINT"
        keys = ("date", "window_start", "ad_id")
        # Counts of windows that are open or were; what was emitted when they closed; what came after that.
        self.window_counts = ChangeLog(at("ad_window_counts"), keys, "click_count", window, fold_every=fold_every)
        self.closed_windows = ChangeLog(at("ad_closed_windows"), keys, "click_count", window, fold_every=fold_every)
        self.late_clicks = BatchLog(at("ad_late_clicks"), _CLICK, lambda rows: rows, fold_every=fold_every)
        self.watermarks = BatchLog(at("ad_watermarks"), "newest TIMESTAMP", _newest, fold_every=fold_every)
        self.province_top3_path = at("ad_province_top3")
        self._checkpoints = at("checkpoints")

    def checkpoint(self, query: str) -> str:
        return os.path.join(self._checkpoints, query)

    def province_top3(self, spark: SparkSession) -> DataFrame:
        schema = "date DATE, province STRING, ad_id BIGINT, click_count BIGINT"
        return read_or_empty(spark, self.province_top3_path, schema)

    def sliding_totals(self, spark: SparkSession, length: str = "60 minutes", slide: str = "10 minutes") -> DataFrame:
        """Totals of all windows. ``slide`` is that of the stream that counted the panes."""
        return windows_of(self.panes.totals(spark), length, slide)

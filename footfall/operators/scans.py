"""Scans of the action table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import within, within_days


def action_scan(actions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Actions between two times, both included. The day condition prunes partitions."""
    return actions.where(within_days("date", start, end) & within(actions, "action_time", start, end))


def click_scan(
    actions: DataFrame, start: str | None, end: str | None, keep: Sequence[str] = ()
) -> DataFrame:
    """City and product of every product click between two times, and further columns on request."""
    clicks = action_scan(actions, start, end).where(F.col("click_product_id").isNotNull())
    return clicks.select("city_id", F.col("click_product_id").alias("product_id"), *keep)

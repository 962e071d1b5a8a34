"""Live ad clicks: everything that runs on one stream of click log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.adclicks import BLACKLIST_THRESHOLD
from footfall.sources.adlog import parse_ad_log
from footfall.streaming import pipelines
from footfall.streaming.tables import AdTables


def start_ad_clicks(
    lines: DataFrame,
    tables: AdTables,
    *,
    threshold: int = BLACKLIST_THRESHOLD,
    every: str | None = "1 minute",
    trend_every: str | None = "1 minute",
) -> list[StreamingQuery]:
    """Start the queries: blacklist with statistics and ranking, minute trend, sliding totals.

    The trend and the sliding totals look at all clicks, also those of blacklisted users. Every
    micro-batch adds a folder to each day of its tables, so triggers of a second suit short runs and
    triggers of a minute suit long ones.
    """
    clicks = parse_ad_log(lines).clicks
    return [
        pipelines.clean_click_stream(clicks, tables, threshold=threshold, every=every),
        pipelines.trend_stream(clicks, tables, every=trend_every),
        pipelines.sliding_stream(clicks, tables, every=trend_every),
    ]

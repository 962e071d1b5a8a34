"""The ad click text log: ``<epoch millis> <province> <city> <user id> <ad id>``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ParsedLog(NamedTuple):
    clicks: DataFrame
    quarantine: DataFrame


# Times before 1970 or from 2200 on are damaged numbers, not times.
EARLIEST_MILLIS = 0
LATEST_MILLIS = 7_258_118_400_000


def parse_ad_log(
    lines: DataFrame, column: str = "value", earliest: int = EARLIEST_MILLIS, latest: int = LATEST_MILLIS
) -> ParsedLog:
    """Split lines into typed clicks. Works on static and on streaming frames.

    A line without exactly five fields, with text where a number belongs, or with a time before
    ``earliest`` or not before ``latest`` is quarantined whole.
    """
    part = F.split(F.col(column), " ")
    millis = F.get(part, F.lit(0)).try_cast("bigint")
    plausible = (F.size(part) == 5) & (millis >= earliest) & (millis < latest)
    fields = F.struct(
        F.col(column).alias("line"),
        F.when(plausible, F.timestamp_millis(millis)).alias("ts"),
        F.get(part, F.lit(1)).alias("province"),
        F.get(part, F.lit(2)).alias("city"),
        F.get(part, F.lit(3)).try_cast("bigint").alias("user_id"),
        F.get(part, F.lit(4)).try_cast("bigint").alias("ad_id"),
    )
    # Generating the fields, not just selecting them, keeps the check below from being pushed into
    # the parsing, where it would parse each line a second time.
    parsed = lines.select(F.inline(F.array(fields)))
    complete = F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("ad_id").isNotNull()
    return ParsedLog(parsed.where(complete).drop("line"), parsed.where(~complete).select("line"))

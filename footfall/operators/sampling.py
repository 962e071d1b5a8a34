"""A sample of sessions that follows the traffic of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.times import date_hour


# Buckets are the first digits of the draw, so a bucket's sessions follow those of all lower ones.
DIGITS = 3


def _quotas(per_hour: DataFrame, size: int) -> DataFrame:
    """The total is a window over the counts, one row per hour of the period."""
    with_total = per_hour.withColumn("total", F.sum("session_count").over(Window.partitionBy()))
    share = F.expr(f"session_count * {int(size)}L div total")
    return with_total.withColumn("quota", F.least(share, F.col("session_count")))


def hour_quotas(sessions: DataFrame, size: int) -> DataFrame:
    """Sessions per hour, and how many of them a sample of ``size`` takes: its share, rounded down."""
    per_hour = sessions.groupBy(date_hour(F.col("start_time")).alias("date_hour")).agg(
        F.count(F.lit(1)).alias("session_count")
    )
    return _quotas(per_hour, size)


def session_sample(sessions: DataFrame, size: int, seed: str = "0", digits: int = DIGITS) -> DataFrame:
    """Draw each hour's quota without replacement, in an order fixed by the seed.

    Sessions are counted by hour and bucket, the first ``digits`` hexadecimal digits of their draw,
    and the counts added up along the buckets of each hour. Buckets below the quota are taken whole;
    only the bucket the quota falls into is cut. So what is ranked is the sample and one bucket an
    hour more, each bucket by itself, however many sessions an hour has.
    """
    draw = F.md5(F.concat("session_id", F.lit(seed)))
    drawn = sessions.withColumns({"date_hour": date_hour(F.col("start_time")), "draw": draw})
    drawn = drawn.withColumn("bucket", F.substring("draw", 1, digits))
    counts = drawn.groupBy("date_hour", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    quotas = _quotas(counts.groupBy("date_hour").agg(F.sum("in_bucket").alias("session_count")), size)
    along = Window.partitionBy("date_hour").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        counts.withColumn("below", F.coalesce(F.sum("in_bucket").over(along), F.lit(0)))
        .join(quotas.where("quota > 0").select("date_hour", "quota"), "date_hour")
        .select("date_hour", "bucket", (F.col("quota") - F.col("below")).alias("wanted"))
        .where("wanted > 0")
    )
    in_bucket = Window.partitionBy("date_hour", "bucket").orderBy("draw", "session_id")
    return (
        drawn.join(cuts, ["date_hour", "bucket"])
        .withColumn("rank", F.row_number().over(in_bucket))
        .where(F.col("rank") <= F.col("wanted"))
        .select(*sessions.columns)
    )

"""How long and how deep sessions are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import DURATION_BUCKETS, STEP_BUCKETS, bucket_condition


def session_counts(sessions: DataFrame) -> DataFrame:
    """One row: the number of sessions, and of those in each length and step range.

    One conditional aggregation; only one row per input partition is shuffled.
    """
    ranges = [(b, "visit_length") for b in DURATION_BUCKETS] + [(b, "step_length") for b in STEP_BUCKETS]
    counters = [F.expr(f"count_if({bucket_condition(c, b)}) AS `{b[0]}`") for b, c in ranges]
    return sessions.agg(F.count(F.lit(1)).alias("session_count"), *counters)


def session_histogram(sessions: DataFrame) -> DataFrame:
    """Share of each range among all sessions; no row if there are none."""
    shares = [
        f"round(try_divide(CAST(`{b[0]}` AS DOUBLE), CAST(session_count AS DOUBLE)), 2) AS `{b[0]}`"
        for b in DURATION_BUCKETS + STEP_BUCKETS
    ]
    return session_counts(sessions).where("session_count > 0").selectExpr("session_count", *shares)

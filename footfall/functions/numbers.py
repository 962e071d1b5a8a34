"""Ratios, money and labelled ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Bucket = tuple[str, int, int | None]

# Labels with inclusive bounds, in seconds and in steps.
DURATION_BUCKETS: tuple[Bucket, ...] = (
    ("1s_3s", 1, 3),
    ("4s_6s", 4, 6),
    ("7s_9s", 7, 9),
    ("10s_30s", 10, 30),
    ("30s_60s", 31, 60),
    ("1m_3m", 61, 180),
    ("3m_10m", 181, 600),
    ("10m_30m", 601, 1800),
    ("30m", 1801, None),
)
STEP_BUCKETS: tuple[Bucket, ...] = (
    ("1_3", 1, 3),
    ("4_6", 4, 6),
    ("7_9", 7, 9),
    ("10_30", 10, 30),
    ("30_60", 31, 60),
    ("60", 61, None),
)


def in_bucket(value: Column, bucket: Bucket) -> Column:
    _, low, high = bucket
    return value >= low if high is None else value.between(low, high)


def bucket_condition(column: str, bucket: Bucket) -> str:
    """The range as a SQL condition, for aggregations over many ranges."""
    _, low, high = bucket
    return f"{column} >= {low}" if high is None else f"{column} BETWEEN {low} AND {high}"


def bucket_label(value: Column, buckets: Sequence[Bucket]) -> Column:
    """Label of the range that holds the value; NULL outside all of them."""
    label = F.lit(None).cast("string")
    for bucket in reversed(buckets):
        label = F.when(in_bucket(value, bucket), F.lit(bucket[0])).otherwise(label)
    return label


def ratio(part: Column, total: Column, digits: int = 2) -> Column:
    """Rounded share; NULL over a zero total."""
    return F.round(F.try_divide(part.cast("double"), total.cast("double")), digits)


def exact_money(amount: Column) -> Column:
    """Money as an exact number: sums do not depend on the order of addition.

    NULL for what is no amount of money: NaN, infinity and numbers of 1e28 or more.
    """
    return amount.try_cast("decimal(38,10)")


def is_unusable_money(amount: Column) -> Column:
    """Whether an amount is there but can't be added."""
    return amount.isNotNull() & exact_money(amount).isNull()


def money_sum(amount: Column, digits: int = 2) -> Column:
    """Sum of money, added exactly and so in any order, then rounded once. Unusable amounts are left out."""
    return F.round(F.try_sum(exact_money(amount)), digits).cast("double")

"""Keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 1000


def hot_keys(rows: DataFrame, key: str, share: float, tracked: int = TRACKED) -> list:
    """The values of a column that hold at least ``share`` of all rows, by a frequent-items sketch; at most ``1 / share``.

    Every task keeps ``tracked`` values with counts, and the sketches are merged: one pass over the key column, which
    shuffles a sketch a task. Counts are off by some ``rows / tracked`` at most, so values are named from a little
    less than ``share`` on, and no value above it is missed. NULL is no key.
    """
    if not 4 / tracked <= share <= 1:
        raise ValueError("the share must be between four times the sketch's error and one")
    most = int(1 / (share - 2 / tracked)) + 1
    named = rows.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    found = named.head()
    return [item for item, count in found["top"] or [] if count >= (share - 2 / tracked) * found["rows"]]

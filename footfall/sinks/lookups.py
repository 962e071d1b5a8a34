"""Result tables laid out for point lookups: few keys out of very many, without reading the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 8 << 20
MAX_KEYS = 1000  # more keys are a join, not a lookup
_IN_THRESHOLD = "spark.sql.parquet.pushdown.inFilterThreshold"


def store_for_lookup(
    rows: DataFrame, path: str, key: str, day: str = "date", *, keys_a_group: int = 100_000, group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write a table, a folder a day, sorted by ``key``, with a Bloom filter on it in every row group.

    Statistics leave out the row groups whose range a key is not in, the filters those that hold its neighbours but not the
    key itself. Small row groups make a lookup read little; ``keys_a_group`` is how many keys one is expected to hold.
    """
    dealt = rows.repartitionByRange(day, key).sortWithinPartitions(day, key)
    (
        dealt.write.mode("errorifexists")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_a_group))
        .option("parquet.block.size", str(group_bytes))
        .partitionBy(day)
        .parquet(path)
    )


def look_up(
    spark: SparkSession, path: str, schema: str, key: str, keys: Sequence[int], days: Sequence | None = None, day: str = "date"
) -> DataFrame:
    """The rows of some keys, of all days or of some. Keys and days reach the scan as literals, so it can skip row groups."""
    wanted = sorted(set(keys))
    if len(wanted) > MAX_KEYS:
        raise ValueError(f"{len(wanted)} keys are too many for a lookup; join them")
    # Longer lists are pushed down as their range only.
    spark.conf.set(_IN_THRESHOLD, str(MAX_KEYS))
    found = spark.read.schema(schema).parquet(path).where(F.col(key).isin(wanted))
    return found if days is None else found.where(F.col(day).isin(list(days)))

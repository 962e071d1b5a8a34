"""Table scans: Parquet folders, catalog tables and JDBC relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import parse_time_ntz
from footfall.sources.jsonl import Checked


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def jdbc_options(
    url: str,
    table: str,
    *,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options. With a partition column the relation is read by many tasks, not by one."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    if partition_column is not None:
        if bounds is None or partitions is None:
            raise ValueError("a partition column needs bounds and a number of partitions")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return options


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def typed_actions(raw: DataFrame) -> Checked:
    """Actions whose day and time are strings, with proper types.

    Rows with a day or time that can't be read are quarantined as they are.
    """
    typed = {"action_time": parse_time_ntz(F.col("action_time")), "date": F.try_to_date("date", "yyyy-MM-dd")}
    damaged = F.lit(False)
    for name, value in typed.items():
        damaged |= F.col(name).isNotNull() & value.isNull()
    return Checked(raw.where(~damaged).withColumns(typed), raw.where(damaged))


def named_view(df: DataFrame, name: str) -> DataFrame:
    """Offer a step of an analysis to SQL users under a view name."""
    df.createOrReplaceTempView(name)
    return df

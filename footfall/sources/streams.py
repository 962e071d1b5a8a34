"""Streaming sources. Topics in production, folders of files in tests and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def kafka_options(
    servers: str,
    topics: str,
    *,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options; ``topics`` is a comma list. Needs Spark's Kafka package on the class path."""
    names = [t.strip() for t in topics.split(",") if t.strip()]
    if not names:
        raise ValueError("no topic given")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(names),
        "startingOffsets": starting_offsets,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_kafka_lines(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The message bodies of the topics as text, in a column named ``value``."""
    return spark.readStream.format("kafka").options(**options).load().selectExpr("CAST(value AS STRING) AS value")


def read_text_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def read_parquet_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    files_per_batch: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)
